"""The registered queries and their DuckDB twins, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..functions.pseudonym import pads, pseudonym
from ..operators import entities, evaluate, identity, panel, quality, rankers, sequences, split
from ..streaming import events as live
from ..settings import ALPHA_GRID, RIDGE_GRID
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A salt for the query on test tables; a release takes its own from its settings.
TEST_SALT = "test-salt"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- quality control ----------------------------------------------------------------------------------------------

_DUP = ["CustomerName", "NameHotel", "Rating_clean", "Date_parsed"]
_SEQ = ", ".join(V.SEQ)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return quality.typed(V.reviews(spark, d))


def _missing_sql(c: str) -> str:
    blank = f"{c} IS NULL OR trim({c}) = ''" + (f" OR {V.placeholder_sql(c)}" if c == "CustomerName" else "")
    return f"SELECT '{c}' AS \"column\", true AS present, count(*) FILTER (WHERE {blank}) AS n_missing, round(100.0 * count(*) FILTER (WHERE {blank}) / count(*), 4) AS missing_pct FROM raw"


@query(f"WITH {V.RAW} " + " UNION ALL ".join(_missing_sql(c) for c in ("CustomerName", "NameHotel", "Rating", "Date")) + " UNION ALL SELECT 'Phone', false, NULL, NULL")
def qc_completeness(spark, d):
    return quality.completeness(V.reviews(spark, d), ["CustomerName", "NameHotel", "Rating", "Date", "Phone"], "CustomerName")


@query(f"""WITH {V.TYPED} SELECT count(*) AS n, count(*) FILTER (WHERE Rating_clean IS NULL OR Rating_clean < 0 OR Rating_clean > 10) AS bad_rating, count(*) FILTER (WHERE Date_parsed IS NULL) AS unparsed_date,
    count(*) FILTER (WHERE Date_parsed < DATE '2010-01-01' OR Date_parsed > DATE '2024-12-31') AS date_out_of_window, min(Rating_clean) AS min_rating, max(Rating_clean) AS max_rating, round(avg(Rating_clean), 6) AS mean_rating,
    CAST(min(Date_parsed) AS VARCHAR) AS min_date, CAST(max(Date_parsed) AS VARCHAR) AS max_date FROM typed""")
def qc_range_consistency(spark, d):
    return quality.range_report(_typed(spark, d))


@query(f"WITH {V.TYPED} SELECT {_SEQ}, row_number() OVER (PARTITION BY {', '.join(_DUP)} ORDER BY {_SEQ}) > 1 AS is_dup FROM typed")
def dup_exact_flags(spark, d):
    return quality.duplicate_flags(_typed(spark, d), _DUP, V.SEQ).select(*V.SEQ, "is_dup")


@query(f"WITH {V.TYPED}, k AS (SELECT *, {V.key_sql('NameHotel')} AS hotel_key FROM typed) SELECT {_SEQ}, row_number() OVER (PARTITION BY CustomerName, hotel_key, Date_parsed ORDER BY {_SEQ}) > 1 AS is_dup FROM k")
def dup_near_flags(spark, d):
    return quality.duplicate_flags(_typed(spark, d).withColumn("hotel_key", T.canonical_key(F.col("NameHotel"))), ["CustomerName", "hotel_key", "Date_parsed"], V.SEQ).select(*V.SEQ, "is_dup")


_CLEAN = V.TYPED + f""", flagged AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_DUP)} ORDER BY {_SEQ}) AS nr FROM typed),
    clean AS (SELECT * FROM flagged WHERE nr = 1 AND Rating_clean BETWEEN 0 AND 10 AND Date_parsed IS NOT NULL AND NOT {V.placeholder_sql('CustomerName')})"""


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return quality.clean(_typed(spark, d), _DUP, V.SEQ)


@query(f"WITH {_CLEAN} SELECT CustomerName, NameHotel, Location, Rating_clean, CAST(Date_parsed AS VARCHAR) AS day, source, {_SEQ} FROM clean")
def clean_interactions(spark, d):
    return _clean(spark, d).select("CustomerName", "NameHotel", "Location", "Rating_clean", F.col("Date_parsed").cast("string").alias("day"), "source", *V.SEQ)


@query(f"WITH {V.RAW} SELECT NameHotel, count(DISTINCT Location) AS n FROM raw GROUP BY NameHotel HAVING count(DISTINCT Location) > 1")
def location_conflicts(spark, d):
    return quality.several_values(V.reviews(spark, d), "NameHotel", "Location")


@query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT props) AS props FROM events")
def distinct_counts(spark, d):
    return quality.distinct_counts(V.table(spark, d, "events"), ["user_id", "event_type", "props"])


# ---- text, entities, pseudonyms -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {V.key_sql('text')} AS canonical_key FROM documents")
def canonical_key_docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.canonical_key(F.col("text")).alias("canonical_key"))


@query(f"WITH {V.RAW}, n AS (SELECT DISTINCT NameHotel, Location FROM raw) SELECT NameHotel, Location, {V.type_sql('NameHotel')} AS property_type, {V.discriminative_sql('NameHotel', 'Location')} AS tokens, {V.place_sql('Location')} AS loc_key FROM n")
def property_types(spark, d):
    n = V.reviews(spark, d).select("NameHotel", "Location").distinct()
    return n.withColumns({"property_type": T.property_type(F.col("NameHotel")), "tokens": T.discriminative_key(F.col("NameHotel"), F.col("Location")), "loc_key": T.canonical_location(F.col("Location"))})


_LISTINGS = f"""p AS (SELECT p_partkey, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' Hotel' WHEN 1 THEN ' Resort' WHEN 2 THEN ' Villa' ELSE '' END) AS name, p_brand AS city FROM part),
    k AS (SELECT *, concat({V.place_sql('city')}, ' | ', {V.discriminative_sql('name', 'city')}) AS base_key, {V.type_sql('name')} AS property_type FROM p)"""


def _listings(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.expr("CASE p_size % 4 WHEN 0 THEN ' Hotel' WHEN 1 THEN ' Resort' WHEN 2 THEN ' Villa' ELSE '' END")
    return V.table(spark, d, "part").select("p_partkey", F.concat("p_name", suffix).alias("name"), F.col("p_brand").alias("city"))


@query(f"""WITH {_LISTINGS}, s AS (SELECT base_key, property_type, count(*) AS c FROM k WHERE property_type <> 'unspecified' GROUP BY ALL),
    t AS (SELECT base_key, count(*) AS n, arg_min(property_type, (-c, property_type)) AS main_type FROM s GROUP BY base_key),
    r AS (SELECT k.*, CASE WHEN coalesce(n, 0) <= 1 THEN coalesce(main_type, 'unspecified') WHEN property_type = 'unspecified' THEN main_type ELSE property_type END AS resolved_type FROM k LEFT JOIN t USING (base_key))
    SELECT p_partkey, base_key, property_type, resolved_type, concat(base_key, ' | ', resolved_type) AS entity_key FROM r""")
def resolve_entities_parts(spark, d):
    return entities.resolve(_listings(spark, d), "name", "city").drop("name", "city")


@query(f"""WITH {V.RAW}, g AS (SELECT NameHotel, list_sort(list_distinct(list(source))) AS s FROM raw GROUP BY NameHotel) SELECT NameHotel, len(s) AS n_sources, array_to_string(s, ' | ') AS sources FROM g WHERE len(s) > 1""")
def cross_source_entities(spark, d):
    return entities.cross_source(V.reviews(spark, d), "NameHotel", "source")


def _hmac_sql(x: str) -> str:
    inner, outer = pads(TEST_SALT)
    return f"concat('U', substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({x})))), 1, 12))"


@query(f"SELECT c_custkey, {_hmac_sql('c_name')} AS user_id FROM customer")
def pseudonym_users(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", pseudonym(F.col("c_name"), TEST_SALT).alias("user_id"))


@query(f"WITH {_CLEAN} SELECT {_hmac_sql('CustomerName')} AS user_id, count(*) AS n_interactions FROM clean GROUP BY ALL")
def release_users(spark, d):
    c = _clean(spark, d)
    return entities.release(c.withColumn("entity_key", F.col("NameHotel")), TEST_SALT)["users"]


@query(f"""WITH {_CLEAN}, k AS (SELECT *, {V.key_sql('NameHotel')} AS entity_key FROM clean), i AS (SELECT entity_key, printf('H%04d', row_number() OVER (ORDER BY entity_key)) AS hotel_id FROM (SELECT DISTINCT entity_key FROM k)),
    n AS (SELECT entity_key, arg_min(NameHotel, (-c, NameHotel)) AS name FROM (SELECT entity_key, NameHotel, count(*) AS c FROM k GROUP BY ALL) GROUP BY entity_key),
    l AS (SELECT entity_key, arg_min(Location, (-c, Location)) AS location FROM (SELECT entity_key, Location, count(*) AS c FROM k GROUP BY ALL) GROUP BY entity_key)
    SELECT hotel_id, name, location FROM i JOIN n USING (entity_key) JOIN l USING (entity_key)""")
def release_items_mode(spark, d):
    return entities.release(_clean(spark, d).withColumn("entity_key", T.canonical_key(F.col("NameHotel"))), TEST_SALT)["hotels"]


# ---- splits and characterisation ----------------------------------------------------------------------------------

_FOLDS = V.EV + """, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, event_id DESC) AS b FROM ev),
    f AS (SELECT user_id, item_id, rating, ts, source, event_id, CASE b WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS fold FROM n WHERE c >= 4)"""


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return split.temporal_folds(V.interactions(spark, d), "user_id", ["ts", "item_id", "event_id"])


@query(f"WITH {_FOLDS} SELECT event_id, user_id, item_id, fold FROM f")
def split_folds(spark, d):
    return _folds(spark, d).select("event_id", "user_id", "item_id", "fold")


_STATS = "SELECT fold, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day, round(avg(rating), 6) AS mean_rating"


@query(f"WITH {_FOLDS} {_STATS} FROM f GROUP BY fold")
def split_fold_stats(spark, d):
    return split.fold_stats(_folds(spark, d), "user_id", "item_id", "ts")


@query(f"WITH {_FOLDS} {_STATS} FROM f WHERE fold = 'train' OR rating >= 20 GROUP BY fold")
def split_relevance_filter(spark, d):
    return split.fold_stats(split.relevant(_folds(spark, d), 20.0), "user_id", "item_id", "ts")


@query(f"""WITH {V.EV}, n AS (SELECT *, md5(concat_ws('|', CAST(event_id AS VARCHAR), '42')) AS h, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, event_id DESC) AS b FROM n WHERE c >= 4) SELECT event_id, CASE b WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS fold FROM r""")
def split_random(spark, d):
    return split.random_folds(V.interactions(spark, d), "user_id", ["event_id"]).select("event_id", "fold")


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS userID FROM (SELECT DISTINCT user_id FROM events)")
def id_maps(spark, d):
    return split.dense_ids(V.table(spark, d, "events"), "user_id", "userID").withColumn("userID", F.col("userID").cast("long"))


_GINI = "SELECT round((n + 1 - 2 * sum(cum) / max(total)) / n, 6) FROM (SELECT sum(c) OVER (ORDER BY c, item_id ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER () AS total, count(*) OVER () AS n FROM it) GROUP BY n"
_ITEMS = V.EV + ", it AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS c FROM ev GROUP BY item_id)"
_HEAD = "SELECT CAST(max(k) AS BIGINT) AS n_head, round(100.0 * sum(CASE WHEN i <= k THEN c ELSE 0 END) / sum(c), 4) AS share_pct FROM (SELECT c, row_number() OVER (ORDER BY c DESC) AS i, ceil(0.2 * count(*) OVER ()) AS k FROM it)"


@query(f"""WITH {_ITEMS}, u AS (SELECT user_id, count(*) AS c FROM ev GROUP BY user_id), h AS ({_HEAD})
    SELECT *, round(100.0 * (1 - n / (n_users * CAST(n_items AS DOUBLE))), 4) AS sparsity_pct FROM (SELECT
    (SELECT count(*) FROM u) AS n_users, (SELECT CAST(sum(c) AS BIGINT) FROM u) AS n, (SELECT round(avg(c), 6) FROM u) AS mean_per_user, (SELECT CAST(quantile_cont(c, 0.5) AS DOUBLE) FROM u) AS median_per_user,
    (SELECT round(100.0 * avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 4) FROM u) AS single_pct, (SELECT round(avg(rating), 6) FROM ev) AS mean_rating, (SELECT round(stddev_samp(rating), 6) FROM ev) AS sd_rating,
    (SELECT count(*) FROM it) AS n_items, ({_GINI}) AS gini, (SELECT n_head FROM h) AS n_head, (SELECT share_pct FROM h) AS head_pct)""")
def characterize(spark, d):
    return split.characterise(V.interactions(spark, d), "user_id", "item_id")


@query(f"WITH {_ITEMS} SELECT (SELECT count(*) FROM it) AS n, ({_GINI}) AS gini")
def gini_items(spark, d):
    return S.gini(V.interactions(spark, d).groupBy("item_id").agg(F.count("*").alias("c")), "c")


@query(f"WITH {_ITEMS} {_HEAD}")
def head_share(spark, d):
    return S.head_share(V.interactions(spark, d).groupBy("item_id").agg(F.count("*").cast("double").alias("c")), "c")


@query(f"""WITH {_ITEMS}, r AS (SELECT row_number() OVER (ORDER BY c) AS i, sum(c) OVER (ORDER BY c, item_id ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER () AS total, count(*) OVER () AS n FROM it)
    SELECT CAST(ceil(i * 10.0 / n) AS INTEGER) AS step, round(max(cum / total), 6) AS share FROM r GROUP BY 1""")
def lorenz_points(spark, d):
    return S.lorenz(V.interactions(spark, d).groupBy("item_id").agg(F.count("*").cast("double").alias("c")), "c")


@query(f"""WITH {V.EV}, u AS (SELECT user_id, count(*) AS c FROM ev GROUP BY user_id) SELECT k.min_k, count(*) AS n, count(DISTINCT ev.user_id) AS users, count(DISTINCT item_id) AS items
    FROM ev JOIN u USING (user_id) JOIN (SELECT unnest([2, 3, 4, 5, 8, 60]) AS min_k) k ON c >= k.min_k GROUP BY k.min_k""")
def min_k_sweep(spark, d):
    return split.min_k_sweep(V.interactions(spark, d), "user_id", "item_id", (2, 3, 4, 5, 8, 60))


@query("SELECT CAST(least(floor((value - 0.0) / 5.0), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def hist_ratings(spark, d):
    return split.histogram(V.interactions(spark, d), "rating", 0.0, 100.0, 5.0)


@query("SELECT CAST(least(c, 30) AS INTEGER) AS rows, count(*) AS keys FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) GROUP BY 1")
def hist_user_activity(spark, d):
    return split.clipped_counts(V.table(spark, d, "orders"), "o_custkey", 30)


# ---- rankers ------------------------------------------------------------------------------------------------------

_TRAIN = _FOLDS + ", tr AS (SELECT DISTINCT user_id, item_id FROM f WHERE fold = 'train'), cnt AS (SELECT item_id, count(*) AS n FROM tr GROUP BY item_id), un AS (SELECT user_id, count(*) AS n FROM tr GROUP BY user_id), items AS (SELECT DISTINCT item_id FROM f), users AS (SELECT DISTINCT user_id FROM tr)"
_TOP10 = "SELECT user_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s ANTI JOIN tr USING (user_id, item_id)) WHERE rank <= 10"


def _train(spark: SparkSession, d: str) -> DataFrame:
    return rankers.interactions(_folds(spark, d).where("fold = 'train'"))


def _top10(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    return rankers.top_k(rankers.unseen(scores, pairs), 10).select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_TRAIN}, s AS (SELECT user_id, item_id, CAST(n AS DOUBLE) AS score FROM users CROSS JOIN cnt) {_TOP10}".replace("CROSS JOIN cnt)", "CROSS JOIN (SELECT item_id, n FROM cnt))"))
def mostpop_top10(spark, d):
    return rankers.mostpop_top(_train(spark, d), 10).select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


_ITEMKNN = """sim AS (SELECT a.item_id AS a, b.item_id AS b, count(*) / sqrt(max(ca.n) * CAST(max(cb.n) AS DOUBLE)) AS sim FROM tr a JOIN tr b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN cnt ca ON ca.item_id = a.item_id JOIN cnt cb ON cb.item_id = b.item_id GROUP BY 1, 2)"""


@query(f"WITH {_TRAIN}, {_ITEMKNN}, s AS (SELECT user_id, b AS item_id, round(sum(sim), 12) AS score FROM tr JOIN sim ON tr.item_id = sim.a GROUP BY 1, 2) {_TOP10}")
def itemknn_top10(spark, d):
    return _top10(rankers.itemknn(_train(spark, d)), _train(spark, d))


@query(f"""WITH {_TRAIN}, {_ITEMKNN}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS nr FROM sim) WHERE nr <= 20),
    s AS (SELECT user_id, near.a AS item_id, round(sum(sim), 12) AS score FROM tr JOIN near ON tr.item_id = near.b GROUP BY 1, 2) {_TOP10}""")
def itemknn20_top10(spark, d):
    pairs = _train(spark, d)
    return _top10(rankers.itemknn(pairs, 20), pairs)


@query(f"""WITH {_TRAIN}, sim AS (SELECT a.user_id AS u, b.user_id AS v, count(*) / sqrt(max(ua.n) * CAST(max(ub.n) AS DOUBLE)) AS sim FROM tr a JOIN tr b ON a.item_id = b.item_id AND a.user_id <> b.user_id
    JOIN un ua ON ua.user_id = a.user_id JOIN un ub ON ub.user_id = b.user_id GROUP BY 1, 2), s AS (SELECT u AS user_id, item_id, round(sum(sim), 12) AS score FROM sim JOIN tr ON tr.user_id = sim.v GROUP BY 1, 2) {_TOP10}""")
def userknn_top10(spark, d):
    return _top10(rankers.userknn(_train(spark, d)), _train(spark, d))


def _docs_tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9à-ỹđ\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1)"


#: Item texts for the content rankers: all parts; only the scores meet the items of the events.
_TFIDF = f"""tok AS (SELECT item, {_docs_tokens_sql('txt')} AS t FROM (SELECT p_partkey AS item, concat(p_name, ' ', p_brand, ' ', lower(p_type)) AS txt FROM part)), nd AS (SELECT count(*) AS n FROM tok),
    term AS (SELECT item, len, term, count(*) AS c FROM (SELECT item, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL), voc AS (SELECT term, sum(c) AS f, count(*) AS df FROM term GROUP BY term ORDER BY f DESC, term LIMIT 4000),
    w AS (SELECT item, term.term AS term, c / CAST(len AS DOUBLE) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS weight FROM term JOIN voc ON term.term = voc.term CROSS JOIN nd)"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("item"), F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type")).alias("txt"))
    return rankers.tfidf(p, "item", "txt")


@query(f"WITH {_TFIDF} SELECT CAST(item AS INTEGER) AS item, term, round(weight, 9) AS weight FROM w")
def tfidf_item_weights(spark, d):
    return _weights(spark, d).withColumn("weight", F.round("weight", 9))


_CONTENT = f"""{_TFIDF}, l AS (SELECT item, sqrt(sum(weight * weight)) AS l FROM w GROUP BY item), iw AS (SELECT w.item, term, weight / l AS weight FROM w JOIN l USING (item)),
    rows_ AS (SELECT user_id, item_id FROM f WHERE fold = 'train'), rn AS (SELECT user_id, count(*) AS n FROM rows_ GROUP BY user_id),
    uw0 AS (SELECT r.user_id, term, sum(weight) / max(n) AS weight FROM rows_ r JOIN iw ON r.item_id = iw.item JOIN rn ON rn.user_id = r.user_id GROUP BY 1, 2), ul AS (SELECT user_id, sqrt(sum(weight * weight)) AS l FROM uw0 GROUP BY user_id),
    uw AS (SELECT uw0.user_id, term, weight / l AS weight FROM uw0 JOIN ul USING (user_id)), cs0 AS (SELECT user_id, item AS item_id, round(sum(uw.weight * iw.weight), 12) AS score FROM uw JOIN iw USING (term) WHERE item IN (SELECT item_id FROM f) GROUP BY 1, 2),
    cs AS (SELECT u.user_id, i.item AS item_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT user_id FROM uw) u CROSS JOIN (SELECT DISTINCT item FROM iw WHERE item IN (SELECT item_id FROM f)) i LEFT JOIN cs0 ON cs0.user_id = u.user_id AND cs0.item_id = i.item)"""


def _content(spark: SparkSession, d: str) -> DataFrame:
    of_events = _weights(spark, d).join(_items(spark, d).select(F.col("item_id").alias("item")), "item", "left_semi")
    return rankers.content_scores(_folds(spark, d).where("fold = 'train'"), of_events)


@query(f"WITH {_TRAIN}, {_CONTENT} SELECT user_id, CAST(item_id AS INTEGER) AS item_id, round(score, 6) AS score FROM cs")
def tfidf_user_scores(spark, d):
    return _content(spark, d).withColumn("score", F.round("score", 6))


_DENSE = f"""{_ITEMKNN}, k0 AS (SELECT user_id, b AS item_id, round(sum(sim), 12) AS score FROM tr JOIN sim ON tr.item_id = sim.a GROUP BY 1, 2), kd AS (SELECT u.user_id, i.item_id, coalesce(k0.score, 0.0) AS score FROM users u CROSS JOIN items i LEFT JOIN k0 USING (user_id, item_id)),
    mm AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-8 THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM kd WINDOW w AS (PARTITION BY user_id))"""


def _cf(spark: SparkSession, d: str) -> DataFrame:
    pairs = _train(spark, d)
    return rankers.minmax(rankers.dense(rankers.itemknn(pairs), pairs.select("user_id").distinct(), _folds(spark, d).select("item_id").distinct()))


@query(f"WITH {_TRAIN}, {_DENSE} SELECT user_id, item_id, round(score, 6) AS score FROM mm")
def minmax_scores(spark, d):
    return _cf(spark, d).withColumn("score", F.round("score", 6))


_RANKS = """sn AS (SELECT user_id, count(*) AS n_seen FROM tr GROUP BY user_id), ni AS (SELECT count(*) AS n_items FROM items),
    tgt AS (SELECT user_id, item_id AS target FROM f WHERE fold = '{fold}'),
    a AS (SELECT {by} s.user_id, s.item_id, s.score, t.target, (tr.item_id IS NOT NULL) AS seen, ts.score AS ts, (tt.item_id IS NOT NULL) AS masked FROM sd s JOIN tgt t ON t.user_id = s.user_id JOIN sd ts ON ts.user_id = s.user_id AND ts.item_id = t.target {same} LEFT JOIN tr ON tr.user_id = s.user_id AND tr.item_id = s.item_id LEFT JOIN tr tt ON tt.user_id = s.user_id AND tt.item_id = t.target),
    rk AS (SELECT {by} user_id, target AS item_id, bool_or(masked) AS masked, CASE WHEN bool_or(masked) THEN 1 + count(*) FILTER (WHERE NOT seen) + count(*) FILTER (WHERE seen AND item_id < target) ELSE 1 + count(*) FILTER (WHERE NOT seen AND (score > ts OR score = ts AND item_id < target)) END AS rank FROM a s GROUP BY {by} user_id, target)"""


def _ranks_sql(fold: str = "test", by: str = "") -> str:
    return _RANKS.replace("{fold}", fold).replace("{by}", f"s.{by}, " if by else "").replace("{same}", f"AND ts.{by} = s.{by}" if by else "")


def _metric_sql(by: str = "", source: str = "rk") -> str:
    cols = ["round(avg(1.0 / rank), 4) AS mrr"]
    for k in (5, 10):
        hit = f"CASE WHEN NOT masked AND rank <= {k} THEN 1.0 ELSE 0.0 END"
        cols += [f"round(avg({hit} / rank), 4) AS map_{k}", f"round(avg({hit} / log2(rank + 1.0)), 4) AS ndcg_{k}", f"round(avg({hit} / {k}), 4) AS p_{k}", f"round(avg({hit}), 4) AS r_{k}"]
    return f"SELECT {by + ', ' if by else ''}count(*) AS n_users, {', '.join(cols)} FROM {source}" + (f" GROUP BY {by}" if by else "")


def _targets(spark: SparkSession, d: str, fold: str = "test") -> DataFrame:
    return _folds(spark, d).where(F.col("fold") == fold).select("user_id", "item_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d).select("item_id").distinct()


_POP = "sd AS (SELECT u.user_id, i.item_id, CAST(coalesce(c.n, 0) AS DOUBLE) AS score FROM users u CROSS JOIN items i LEFT JOIN cnt c USING (item_id))"


@query(f"WITH {_TRAIN}, {_POP}, {_ranks_sql()} {_metric_sql()}")
def rank_metrics(spark, d):
    """Popularity ranking of the temporal split on the test fold."""
    return evaluate.metrics(_pop_ranks(spark, d))


def _pop_ranks(spark: SparkSession, d: str) -> DataFrame:
    pairs = _train(spark, d)
    return evaluate.static_ranks(rankers.popularity(pairs), pairs, _targets(spark, d), _items(spark, d))


_KNN_SD = f"{_ITEMKNN}, k0 AS (SELECT user_id, b AS item_id, round(sum(sim), 12) AS score FROM tr JOIN sim ON tr.item_id = sim.a GROUP BY 1, 2), sd AS (SELECT u.user_id, i.item_id, coalesce(k0.score, 0.0) AS score FROM users u CROSS JOIN items i LEFT JOIN k0 USING (user_id, item_id))"


def _knn_ranks(spark: SparkSession, d: str) -> DataFrame:
    pairs = _train(spark, d)
    return evaluate.target_ranks(rankers.itemknn(pairs), pairs, _targets(spark, d), _items(spark, d))


@query(f"WITH {_TRAIN}, {_KNN_SD}, {_ranks_sql()} SELECT user_id, item_id, rank, masked FROM rk")
def itemknn_ranks(spark, d):
    return _knn_ranks(spark, d)


@query(f"""WITH {_TRAIN}, {_KNN_SD}, {_ranks_sql()}, hn AS (SELECT user_id, count(*) AS n FROM f WHERE fold = 'train' GROUP BY user_id),
    b AS (SELECT rk.*, CASE WHEN n = 2 THEN '2' WHEN n BETWEEN 3 AND 4 THEN '3-4' WHEN n BETWEEN 5 AND 10 THEN '5-10' ELSE '11+' END AS bucket FROM rk LEFT JOIN hn USING (user_id)),
    g AS (SELECT bucket, count(*) AS n_users, avg(CASE WHEN NOT masked AND rank <= 10 THEN 1.0 ELSE 0 END) AS recall, avg(CASE WHEN NOT masked AND rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0 END) AS ndcg, avg(1.0 / rank) AS mrr FROM b GROUP BY bucket)
    SELECT e.bucket, coalesce(n_users, 0) AS n_users, coalesce(round(recall, 4), 0.0) AS recall, coalesce(round(ndcg, 4), 0.0) AS ndcg, coalesce(round(mrr, 4), 0.0) AS mrr FROM (SELECT unnest(['2', '3-4', '5-10', '11+']) AS bucket) e LEFT JOIN g USING (bucket)""")
def history_bucket_metrics(spark, d):
    return evaluate.by_history(_knn_ranks(spark, d), _folds(spark, d).where("fold = 'train'"))


_GRID = ", ".join(f"{k / 10}" for k in range(11))
_BOTH = f"{_DENSE}, {_CONTENT}, cm AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-8 THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM cs WINDOW w AS (PARTITION BY user_id)), both_ AS (SELECT mm.user_id, mm.item_id, mm.score AS cf, cm.score AS cb FROM mm LEFT JOIN cm ON cm.user_id = mm.user_id AND cm.item_id = mm.item_id)"


def _both(spark: SparkSession, d: str) -> DataFrame:
    cb = rankers.minmax(_content(spark, d)).withColumnRenamed("score", "cb")
    return _cf(spark, d).withColumnRenamed("score", "cf").join(cb, ["user_id", "item_id"], "left")


@query(f"""WITH {_TRAIN}, {_BOTH}, sd AS (SELECT lam, user_id, item_id, round(lam * cf + (1 - lam) * coalesce(cb, cf), 12) AS score FROM both_ CROSS JOIN (SELECT unnest([{_GRID}])::DOUBLE AS lam)), {_ranks_sql('val', 'lam')} {_metric_sql('lam')}""")
def hybrid_fixed_grid(spark, d):
    """All weights of the fixed fusion, ranked and evaluated on the val fold in one plan."""
    grid = F.explode(F.array(*[F.lit(k / 10) for k in range(11)]))
    s = _both(spark, d).withColumn("lam", grid).select("lam", "user_id", "item_id", F.round(rankers.fused(F.col("cf"), F.col("cb"), F.col("lam")), 12).alias("score"))
    return evaluate.metrics(evaluate.target_ranks(s, _train(spark, d), _targets(spark, d, "val"), _items(spark, d), ["lam"], spark.range(1).select(grid.alias("lam"))), ["lam"])


@query(f"""WITH {_TRAIN}, {_BOTH}, hn AS (SELECT user_id, count(*) AS n FROM f WHERE fold = 'train' GROUP BY user_id), grid AS (SELECT * FROM (SELECT unnest([40.0, 60.0, 80.0])::DOUBLE AS n0) CROSS JOIN (SELECT unnest([0.5, 0.85])::DOUBLE AS lo)),
    sd AS (SELECT n0 * 10 + lo AS setting, both_.user_id, item_id, round((lo + (1 - lo) / (1 + exp(-(n - n0) / 8.0))) * cf + (1 - (lo + (1 - lo) / (1 + exp(-(n - n0) / 8.0)))) * coalesce(cb, cf), 9) AS score FROM both_ JOIN hn ON hn.user_id = both_.user_id CROSS JOIN grid), {_ranks_sql('val', 'setting')} {_metric_sql('setting')}""")
def hybrid_adaptive_grid(spark, d):
    """A grid of adaptive fusions, the weight by the user's train rows, on the val fold."""
    n = _folds(spark, d).where("fold = 'train'").groupBy("user_id").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("n0"), F.lit(b).alias("lo")) for a in (40.0, 60.0, 80.0) for b in (0.5, 0.85)]))
    s = _both(spark, d).join(n, "user_id").withColumn("g", grid)
    w = rankers.adaptive_weight(F.col("n"), F.col("g.n0"), 8.0, F.col("g.lo"))
    s = s.select((F.col("g.n0") * 10 + F.col("g.lo")).alias("setting"), "user_id", "item_id", F.round(rankers.fused(F.col("cf"), F.col("cb"), w), 9).alias("score"))
    return evaluate.metrics(evaluate.target_ranks(s, _train(spark, d), _targets(spark, d, "val"), _items(spark, d), ["setting"], spark.range(1).select(grid.alias("g")).select((F.col("g.n0") * 10 + F.col("g.lo")).alias("setting"))), ["setting"])


def _second(sql: str) -> str:
    """_RANKS under other names, for a second evaluation in one statement."""
    for old, new in (("sn AS", "sn2 AS"), ("ni AS", "ni2 AS"), ("tgt", "tgt2"), ("a AS (", "a2 AS ("), ("FROM a s", "FROM a2 s"), ("sd s ", "sd2 s "), ("sd ts", "sd2 ts"), ("rk AS", "rk2 AS")):
        sql = sql.replace(old, new)
    return sql


_TUNED_COLS = _metric_sql("lam", "rk2 CROSS JOIN best")


@query(f"""WITH {_TRAIN}, {_BOTH}, sd AS (SELECT lam, user_id, item_id, round(lam * cf + (1 - lam) * coalesce(cb, cf), 12) AS score FROM both_ CROSS JOIN (SELECT unnest([{_GRID}])::DOUBLE AS lam)), {_ranks_sql('val', 'lam')}, gm AS ({_metric_sql('lam')}), best AS (SELECT lam FROM gm ORDER BY r_10 DESC, lam LIMIT 1),
    sd2 AS (SELECT user_id, item_id, round(lam * cf + (1 - lam) * coalesce(cb, cf), 12) AS score FROM both_ CROSS JOIN best), {_second(_ranks_sql('test'))} {_TUNED_COLS}""")
def tuned_hybrid(spark, d):
    """The fixed fusion's weight is chosen on the val fold, and that one weight tested."""
    both, pairs = _both(spark, d), _train(spark, d)
    grid = F.explode(F.array(*[F.lit(k / 10) for k in range(11)]))
    fused = lambda x: x.select("lam", "user_id", "item_id", F.round(rankers.fused(F.col("cf"), F.col("cb"), F.col("lam")), 12).alias("score"))
    val = evaluate.target_ranks(fused(both.withColumn("lam", grid)), pairs, _targets(spark, d, "val"), _items(spark, d), ["lam"], spark.range(1).select(grid.alias("lam")))
    return evaluate.tuned(val, lambda best: fused(both.crossJoin(best)), lambda s: evaluate.target_ranks(s, pairs, _targets(spark, d), _items(spark, d)), "lam")


_CURVES = [(a, n0, tau) for a in ALPHA_GRID["alpha_min"] for n0 in ALPHA_GRID["n0"] for tau in ALPHA_GRID["tau"]]
_CURVE_ROWS = ", ".join(f"({k}, {a}::DOUBLE, {n0}::DOUBLE, {tau}::DOUBLE)" for k, (a, n0, tau) in enumerate(_CURVES))
_CURVE_W = "(lo + (1 - lo) / (1 + exp(-(n - n0) / tau)))"


def _curve_scores(spark: SparkSession, d: str, which: DataFrame) -> DataFrame:
    """Scores of the adaptive curves named by `which` (setting), a frame of few rows."""
    n = _folds(spark, d).where("fold = 'train'").groupBy("user_id").agg(F.count("*").alias("n"))
    curves = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(a).alias("lo"), F.lit(n0).alias("n0"), F.lit(tau).alias("tau")) for k, (a, n0, tau) in enumerate(_CURVES)])
    g = spark.range(1).select(F.inline(curves)).join(which.hint("broadcast"), "setting", "left_semi")
    s = _both(spark, d).join(n, "user_id").crossJoin(F.broadcast(g))  # 45 curves at most
    w = rankers.adaptive_weight(F.col("n"), F.col("n0"), F.col("tau"), F.col("lo"))
    return s.select("setting", "user_id", "item_id", F.round(rankers.fused(F.col("cf"), F.col("cb"), w), 9).alias("score"))


@query(f"""WITH {_TRAIN}, {_BOTH}, hn AS (SELECT user_id, count(*) AS n FROM f WHERE fold = 'train' GROUP BY user_id), grid AS (SELECT * FROM (VALUES {_CURVE_ROWS}) AS v(setting, lo, n0, tau)),
    sd AS (SELECT setting, both_.user_id, item_id, round({_CURVE_W} * cf + (1 - {_CURVE_W}) * coalesce(cb, cf), 9) AS score FROM both_ JOIN hn ON hn.user_id = both_.user_id CROSS JOIN grid), {_ranks_sql('val', 'setting')}, gm AS ({_metric_sql('setting')}), best AS (SELECT setting FROM gm ORDER BY r_10 DESC, setting LIMIT 1),
    sd2 AS (SELECT user_id, item_id, score FROM sd JOIN best USING (setting)), {_second(_ranks_sql('test'))} {_metric_sql('setting', 'rk2 CROSS JOIN best')}""")
def tuned_adaptive(spark, d):
    """All 45 curves of the adaptive fusion on the val fold; the best is tested once."""
    pairs = _train(spark, d)
    every = spark.range(len(_CURVES)).select(F.col("id").cast("int").alias("setting"))
    val = evaluate.target_ranks(_curve_scores(spark, d, every), pairs, _targets(spark, d, "val"), _items(spark, d), ["setting"], every)
    return evaluate.tuned(val, lambda best: _curve_scores(spark, d, best), lambda s: evaluate.target_ranks(s, pairs, _targets(spark, d), _items(spark, d)), "setting")


@query()
def tuned_ridge(spark, d):
    """The closed form's penalty is chosen on the val fold among seven, and that one tested."""
    pairs = _train(spark, d)
    lams = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in RIDGE_GRID])).alias("lam"))
    scores = rankers.ridge_grid(pairs)
    val = evaluate.target_ranks(scores, pairs, _targets(spark, d, "val"), _items(spark, d), ["lam"], lams)
    return evaluate.tuned(val, lambda best: scores.join(F.broadcast(best), "lam", "left_semi"), lambda s: evaluate.target_ranks(s, pairs, _targets(spark, d), _items(spark, d)), "lam")


_SWEEP = f"""WITH {_TRAIN}, {_BOTH}, sd AS (SELECT lam, user_id, item_id, round(lam * cf + (1 - lam) * coalesce(cb, cf), 12) AS score FROM both_ CROSS JOIN (SELECT unnest([{_GRID}])::DOUBLE AS lam)), {_ranks_sql('val', 'lam')}, hn AS (SELECT user_id, count(*) AS n FROM f WHERE fold = 'train' GROUP BY user_id),
    sw AS (SELECT lam, CASE WHEN n = 2 THEN '2' WHEN n BETWEEN 3 AND 4 THEN '3-4' WHEN n BETWEEN 5 AND 10 THEN '5-10' ELSE '11+' END AS bucket, count(*) AS n_users, round(avg(CASE WHEN NOT masked AND rank <= 10 THEN 1.0 ELSE 0 END), 4) AS recall FROM rk LEFT JOIN hn USING (user_id) GROUP BY 1, 2)"""


@query(f"{_SWEEP} SELECT * FROM sw")
def lambda_sweep_buckets(spark, d):
    """Recall of every weight by the length of the user's history."""
    grid = F.explode(F.array(*[F.lit(k / 10) for k in range(11)]))
    s = _both(spark, d).withColumn("lam", grid).select("lam", "user_id", "item_id", F.round(rankers.fused(F.col("cf"), F.col("cb"), F.col("lam")), 12).alias("score"))
    ranks = evaluate.target_ranks(s, _train(spark, d), _targets(spark, d, "val"), _items(spark, d), ["lam"], spark.range(1).select(grid.alias("lam")))
    return evaluate.sweep_by_history(ranks, _folds(spark, d).where("fold = 'train'"), "lam")


@query(f"""{_SWEEP}, g AS (SELECT lam, max(CASE WHEN bucket = '11+' THEN recall END) AS bucket_recall, round(sum(recall * n_users) / sum(n_users), 4) AS recall FROM sw GROUP BY lam)
    SELECT lam, bucket_recall, recall FROM g ORDER BY bucket_recall DESC NULLS LAST, recall DESC, lam LIMIT 8""")
def best_sweep_settings(spark, d):
    return evaluate.best_settings(lambda_sweep_buckets(spark, d), "lam", "11+")


_USERKNN_K = """sim AS (SELECT a.user_id AS u, b.user_id AS v, count(*) / sqrt(max(ua.n) * CAST(max(ub.n) AS DOUBLE)) AS sim FROM tr a JOIN tr b ON a.item_id = b.item_id AND a.user_id <> b.user_id JOIN un ua ON ua.user_id = a.user_id JOIN un ub ON ub.user_id = b.user_id GROUP BY 1, 2),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(sim, 12) DESC, v) AS nr FROM sim) WHERE nr <= 200), s AS (SELECT u AS user_id, item_id, round(sum(sim), 12) AS score FROM near JOIN tr ON tr.user_id = near.v GROUP BY 1, 2)"""


@query(f"WITH {_TRAIN}, {_USERKNN_K} {_TOP10}")
def userknn200_top10(spark, d):
    return _top10(rankers.userknn_neighbours(_train(spark, d), 200), _train(spark, d))


@query()
def wmf_top10(spark, d):
    """Weighted matrix factorisation, trained and applied by the distributed alternating least squares."""
    model = rankers.wmf(_folds(spark, d).where("fold = 'train'"), rank=16, iterations=5)
    pairs = _train(spark, d)
    every = pairs.select(F.col("user_id").cast("int").alias("user_id")).distinct().crossJoin(pairs.select(F.col("item_id").cast("int").alias("item_id")).distinct())
    return _top10(model.transform(every).select("user_id", "item_id", F.col("prediction").cast("double").alias("score")), pairs)


@query()
def item_factor_vectors(spark, d):
    """Item factors from the gram's leading eigenvectors."""
    return rankers.item_factors(_train(spark, d), 8).select("item_id", F.transform("factors", lambda x: F.round(x, 6)).alias("factors"))


@query()
def ease_scores(spark, d):
    pairs = _train(spark, d)
    return _top10(rankers.ease(pairs, 100.0), pairs)


@query()
def sansa_scores(spark, d):
    pairs = _train(spark, d)
    return _top10(rankers.sansa(pairs, 100.0), pairs)


@query()
def bpr_top10(spark, d):
    rows = _folds(spark, d).where("fold = 'train'")
    return _top10(rankers.factor_scores(rankers.bpr(rows.select(F.col("user_id").cast("long"), F.col("item_id").cast("long")), epochs=5)), _train(spark, d))


@query()
def lightgcn_top10(spark, d):
    pairs = _train(spark, d)
    model = rankers.lightgcn(pairs.select(F.col("user_id").cast("long"), F.col("item_id").cast("long")), epochs=5)
    return _top10(rankers.factor_scores(model), pairs)


@query(f"""WITH {_TRAIN}, e AS (SELECT concat('u', user_id) AS src, concat('i', item_id) AS dst FROM tr UNION ALL SELECT concat('i', item_id), concat('u', user_id) FROM tr), deg AS (SELECT src, count(*) AS d FROM e GROUP BY src),
    ed AS (SELECT e.src, e.dst, 1 / sqrt(a.d * CAST(b.d AS DOUBLE)) AS w FROM e JOIN deg a ON a.src = e.src JOIN deg b ON b.src = e.dst), s0 AS (SELECT src AS node, CAST(length(src) AS DOUBLE) AS v FROM deg),
    s1 AS (SELECT dst AS node, sum(w * v) AS v FROM ed JOIN s0 ON s0.node = ed.src GROUP BY dst), s2 AS (SELECT dst AS node, sum(w * v) AS v FROM ed JOIN s1 ON s1.node = ed.src GROUP BY dst)
    SELECT node, 0 AS dim, round(sum(v) / 3, 6) AS value FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node""")
def lightgcn_propagation(spark, d):
    edges = rankers.graph_edges(_train(spark, d))
    start = edges.select(F.col("src").alias("node"), F.lit(0).alias("dim"), F.length("src").cast("double").alias("value")).distinct()
    return rankers.propagate(edges, start, 2).withColumn("value", F.round("value", 6))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT a, b, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) WHERE rank <= 10""")
def cosine_embedding_topk(spark, d):
    """Nearest vectors of the stated query set (ids divisible by 50) against all rows."""
    v = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rankers.cosine_top(v, "vec_id", "e", 10, F.col("vec_id") % 50 == 0)


# ---- statistics ---------------------------------------------------------------------------------------------------

_PAIRED = f"""{_TRAIN}, {_KNN_SD}, {_ranks_sql()}, pop AS (SELECT u.user_id, i.item_id, CAST(coalesce(c.n, 0) AS DOUBLE) AS score FROM users u CROSS JOIN items i LEFT JOIN cnt c USING (item_id)),
    pa AS (SELECT s.user_id, s.item_id, s.score, t.target, tr.item_id IS NOT NULL AS seen, ts.score AS ts, tt.item_id IS NOT NULL AS masked FROM pop s JOIN tgt t ON t.user_id = s.user_id JOIN pop ts ON ts.user_id = s.user_id AND ts.item_id = t.target LEFT JOIN tr ON tr.user_id = s.user_id AND tr.item_id = s.item_id LEFT JOIN tr tt ON tt.user_id = s.user_id AND tt.item_id = t.target),
    pk AS (SELECT user_id, target, bool_or(masked) AS masked, CASE WHEN bool_or(masked) THEN 1 + count(*) FILTER (WHERE NOT seen) + count(*) FILTER (WHERE seen AND item_id < target) ELSE 1 + count(*) FILTER (WHERE NOT seen AND (score > ts OR score = ts AND item_id < target)) END AS rank FROM pa GROUP BY user_id, target),
    dd AS (SELECT round(1.0 / rk.rank - 1.0 / pk.rank, 12) AS d FROM rk JOIN pk USING (user_id)), rr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM dd WHERE d <> 0)"""


@query(f"""WITH {_PAIRED} SELECT 'itemknn vs mostpop' AS test, (SELECT count(*) FROM rr WHERE d > 0) AS n_pos, (SELECT count(*) FROM rr WHERE d < 0) AS n_neg, (SELECT count(*) FROM dd WHERE d = 0) AS n_zero,
    (SELECT round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 1) FROM rr) AS statistic, (SELECT round(avg(d), 6) FROM dd) AS mean_diff""")
def wilcoxon_counts(spark, d):
    both = evaluate.paired(_knn_ranks(spark, d), _pop_ranks(spark, d), "mrr").withColumn("test", F.lit("itemknn vs mostpop"))
    return S.wilcoxon(both, "test", "a", "b").select("test", "n_pos", "n_neg", "n_zero", F.round("statistic", 1).alias("statistic"), F.round("mean_diff", 6).alias("mean_diff"))


@query()
def bootstrap_ci(spark, d):
    m = evaluate.per_user(_knn_ranks(spark, d)).withColumn("method", F.lit("itemknn"))
    return S.bootstrap_ci(m, "method", "r_10", n_boot=2000, order="user_id")


# p of the signed-rank test: erfc by a rational approximation whose error is below 2e-7
_ERFC = "(0.254829592 * t - 0.284496736 * t * t + 1.421413741 * t * t * t - 1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-x * x)"


@query(f"""WITH {_PAIRED}, w AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, CAST(count(*) AS DOUBLE) AS n FROM rr), ti AS (SELECT CAST(coalesce(sum(t * t * t - t), 0) AS DOUBLE) AS tie FROM (SELECT count(*) AS t FROM rr GROUP BY abs(d))),
    z AS (SELECT CASE WHEN n >= 10 THEN abs(least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) / sqrt(2.0) END AS x FROM w CROSS JOIN ti)
    SELECT 'itemknn' AS method, 'mostpop' AS against, round((SELECT {_ERFC} FROM (SELECT x, 1 / (1 + 0.3275911 * x) AS t FROM z)), 4) AS p, (SELECT round(avg(d), 6) FROM dd) AS mean_diff""")
def pairwise_tests(spark, d):
    t = evaluate.pairwise({"itemknn": _knn_ranks(spark, d), "mostpop": _pop_ranks(spark, d)}, "mostpop")
    return t.select("method", "against", F.round("p", 4).alias("p"), F.round("mean_diff", 6).alias("mean_diff"))


@query()
def method_ci_table(spark, d):
    """Bootstrap intervals of two methods as a table, with the interval as text."""
    return evaluate.interval_table({"itemknn": _knn_ranks(spark, d), "mostpop": _pop_ranks(spark, d)}, n_boot=2000)


_POP_OF = """tr{x} AS (SELECT DISTINCT user_id, item_id FROM f{x} WHERE fold = 'train'), it{x} AS (SELECT DISTINCT item_id FROM f{x}), pl{x} AS (SELECT item_id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, item_id) AS place FROM it{x} LEFT JOIN (SELECT item_id, count(*) AS n FROM tr{x} GROUP BY item_id) USING (item_id)),
    rk{x} AS (SELECT t.user_id, bool_or(s.item_id = t.item_id) AS masked, max(p.place) - count(*) FILTER (WHERE q.place < p.place) AS rank FROM f{x} t JOIN pl{x} p ON p.item_id = t.item_id LEFT JOIN tr{x} s ON s.user_id = t.user_id LEFT JOIN pl{x} q ON q.item_id = s.item_id WHERE t.fold = 'test' GROUP BY t.user_id)"""


@query(f"""WITH {_FOLDS}, h AS (SELECT *, md5(concat_ws('|', CAST(event_id AS VARCHAR), '42')) AS h, count(*) OVER (PARTITION BY user_id) AS c FROM ev), hr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, event_id DESC) AS b FROM h WHERE c >= 4), fr AS (SELECT user_id, item_id, CASE b WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS fold FROM hr),
    {_POP_OF.replace('{x}', '')}, {_POP_OF.replace('{x}', 'r')}
    SELECT 'temporal' AS protocol, count(*) AS n_users, round(avg(CASE WHEN NOT coalesce(masked, false) AND rank <= 10 THEN 1.0 ELSE 0 END), 4) AS r_10 FROM rk UNION ALL SELECT 'random', count(*), round(avg(CASE WHEN NOT coalesce(masked, false) AND rank <= 10 THEN 1.0 ELSE 0 END), 4) FROM rkr""")
def protocol_ablation(spark, d):
    """Popularity under the temporal and under the random protocol."""
    out = []
    for name, f in split.protocols(V.interactions(spark, d), "user_id", ["ts", "item_id", "event_id"], ["event_id"]).items():
        pairs = rankers.interactions(f.where("fold = 'train'"))
        ranks = evaluate.static_ranks(rankers.popularity(pairs), pairs, f.where("fold = 'test'"), f.select("item_id").distinct())
        out.append(evaluate.metrics(ranks).select(F.lit(name).alias("protocol"), "n_users", "r_10"))
    return out[0].unionByName(out[1])


@query(f"""WITH {_CLEAN}, x AS (SELECT 'on' AS resolution, CustomerName, {V.key_sql('NameHotel')} AS item FROM clean UNION ALL SELECT 'off', CustomerName, NameHotel FROM clean), g AS (SELECT resolution, CustomerName, item, count(*) AS c FROM x GROUP BY ALL)
    SELECT resolution, CAST(sum(c) AS BIGINT) AS n, count(DISTINCT item) AS items, round(sum(c) / CAST(count(DISTINCT item) AS DOUBLE), 4) AS mean_per_item, count(*) AS pairs FROM g GROUP BY resolution""")
def resolution_ablation(spark, d):
    """The clean table with hotels by canonical key and by raw name."""
    return split.resolution_effect(_clean(spark, d).withColumn("key", T.canonical_key(F.col("NameHotel"))), "NameHotel", "key", "CustomerName")


@query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def labels_one_to_one(spark, d):
    """A validated join: neither side may repeat an id."""
    return quality.one_to_one(V.table(spark, d, "labels").select("doc_id", "quality"), V.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], "inner")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(floor(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP))) AS BIGINT) AS day_seconds FROM events")
def epoch_seconds(spark, d):
    ev = V.table(spark, d, "events")
    return ev.select("event_id", T.epoch_seconds(F.col("ts")).alias("seconds"), T.epoch_seconds(F.col("ts").cast("date")).alias("day_seconds"))


_RATERS = "r AS (SELECT doc_id, quality AS a, 1 - toxic AS b, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS c FROM labels)"


def _raters(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "labels").select("doc_id", F.col("quality").alias("annotator_1"), (1 - F.col("toxic")).alias("annotator_2"), F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("annotator_3"))


@query(f"""WITH {_RATERS}, p AS (SELECT 'annotator_1' AS x, 'annotator_2' AS y, a AS p, b AS q FROM r UNION ALL SELECT 'annotator_1', 'annotator_3', a, c FROM r UNION ALL SELECT 'annotator_2', 'annotator_3', b, c FROM r),
    g AS (SELECT x, y, count(*) AS n, avg(CASE WHEN p = q THEN 1.0 ELSE 0 END) AS o, avg(p) AS pa, avg(q) AS pb FROM p WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY x, y)
    SELECT x AS a, y AS b, n, round(o, 4) AS agreement, CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN round((o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 4) END AS kappa FROM g""")
def kappa_raters(spark, d):
    return panel.agreement(_raters(spark, d), ["annotator_1", "annotator_2", "annotator_3"])


@query(f"""WITH {_RATERS}, o AS (SELECT a + b + c AS s FROM r WHERE a + b + c IS NOT NULL), g AS (SELECT count(*) AS n, avg((s * (s - 1) + (3 - s) * (2 - s)) / 6.0) AS o, sum(s) / (3.0 * count(*)) AS p FROM o)
    SELECT n, CASE WHEN p * p + (1 - p) * (1 - p) < 1 THEN round((o - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 4) END AS kappa FROM g""")
def fleiss_raters(spark, d):
    return S.fleiss_kappa(_raters(spark, d), ["annotator_1", "annotator_2", "annotator_3"])


@query(f"""WITH {_RATERS}, v AS (SELECT doc_id, coalesce(a = 1, false)::INT + coalesce(b = 1, false)::INT + coalesce(c = 1, false)::INT AS ones, coalesce(a = 0, false)::INT + coalesce(b = 0, false)::INT + coalesce(c = 0, false)::INT AS zeros FROM r)
    SELECT doc_id, CASE WHEN ones + zeros >= 2 AND ones > zeros THEN 1 WHEN ones + zeros >= 2 AND zeros > ones THEN 0 END AS gold FROM v""")
def gold_majority(spark, d):
    return _raters(spark, d).select("doc_id", panel.gold(["annotator_1", "annotator_2", "annotator_3"]).alias("gold"))


# ---- identity audit -----------------------------------------------------------------------------------------------

_NAMED = V.TYPED + f", named AS (SELECT *, {V.place_sql('Location')} AS loc_key, {V.key_sql('NameHotel')} AS hotel_key FROM typed)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    n = identity.named(_typed(spark, d))
    return n.withColumns({"loc_key": T.canonical_location(F.col("Location")), "hotel_key": T.canonical_key(F.col("NameHotel"))})


@query(rf"""WITH {_NAMED}, p AS (SELECT CustomerName AS name, count(*) AS c FROM named GROUP BY 1), q AS (SELECT c, length(name) AS len, {V.words_sql('name')} AS words, regexp_full_match(trim(name), '[^\s]+(\s+[A-ZĐ]\.)+') AS initials FROM p)
    SELECT CAST(sum(c) AS BIGINT) AS n_interactions, count(*) AS n_names, round(avg(len), 2) AS mean_len, CAST(quantile_cont(len, 0.5) AS DOUBLE) AS median_len, CAST(quantile_cont(len, 0.1) AS DOUBLE) AS p10_len, CAST(quantile_cont(len, 0.9) AS DOUBLE) AS p90_len, CAST(max(len) AS INTEGER) AS max_len,
    count(*) FILTER (WHERE words = 1) AS single_token_names, CAST(coalesce(sum(c) FILTER (WHERE words = 1), 0) AS BIGINT) AS single_token_interactions, count(*) FILTER (WHERE len <= 3) AS short_names, CAST(coalesce(sum(c) FILTER (WHERE len <= 3), 0) AS BIGINT) AS short_interactions, count(*) FILTER (WHERE initials) AS initials_only_names FROM q""")
def name_space_report(spark, d):
    return identity.name_space(_named(spark, d))


@query(f"WITH {_NAMED} SELECT CustomerName, count(*) AS n_interactions, count(DISTINCT loc_key) AS n_cities, CAST({V.words_sql('CustomerName')} AS INTEGER) AS n_tokens FROM named GROUP BY CustomerName ORDER BY n_interactions DESC, CustomerName LIMIT 15")
def top_names(spark, d):
    return identity.top_names(_named(spark, d))


@query(f"WITH {_NAMED} SELECT CAST(words AS INTEGER) AS words, count(*) AS names FROM (SELECT DISTINCT CustomerName, {V.words_sql('CustomerName')} AS words FROM named) GROUP BY 1")
def token_distribution(spark, d):
    return identity.token_distribution(_named(spark, d))


@query(f"WITH {_NAMED} SELECT CustomerName, count(*) AS n_interactions, count(DISTINCT hotel_key) AS n_hotels, count(DISTINCT loc_key) AS n_cities FROM named WHERE {V.placeholder_sql('CustomerName')} GROUP BY 1")
def placeholder_report(spark, d):
    return identity.placeholders(_named(spark, d))


_COLL = _NAMED + ", col AS (SELECT CustomerName, max(cities) AS people FROM (SELECT CustomerName, Date_parsed, count(DISTINCT loc_key) AS cities FROM named WHERE Date_parsed IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING max(cities) > 1)"


@query(f"""WITH {_COLL}, p AS (SELECT CustomerName, count(*) AS c FROM named GROUP BY 1) SELECT count(*) AS n_names, count(people) AS n_colliding, CAST(sum(coalesce(people, 1)) AS BIGINT) AS people, CAST(coalesce(sum(CASE WHEN people IS NOT NULL THEN c END), 0) AS BIGINT) AS colliding_interactions
    FROM p LEFT JOIN col USING (CustomerName)""")
def collision_bound(spark, d):
    return identity.collision_bound(_named(spark, d))


@query(f"""WITH {_NAMED}, p AS (SELECT CustomerName AS name, count(*) AS c, {V.placeholder_sql('CustomerName')} AS ph FROM named GROUP BY 1)
    SELECT CAST(coalesce(sum(c) FILTER (WHERE ph), 0) AS BIGINT) AS placeholder_rows, count(*) FILTER (WHERE ph) AS placeholder_names, CAST(coalesce(sum(c) FILTER (WHERE NOT ph), 0) AS BIGINT) AS rows_left, count(*) FILTER (WHERE NOT ph) AS names_left,
    round(coalesce(sum(c) FILTER (WHERE NOT ph), 0) / CAST(nullif(count(*) FILTER (WHERE NOT ph), 0) AS DOUBLE), 4) AS mean_left FROM p""")
def placeholder_removal(spark, d):
    return identity.placeholder_removal(_named(spark, d))


@query(f"""WITH {_COLL} SELECT 'words' AS kind, CAST(least(words, 5) AS INTEGER) AS size, count(*) AS names FROM (SELECT DISTINCT CustomerName, {V.words_sql('CustomerName')} AS words FROM named) GROUP BY 2
    UNION ALL SELECT 'cities', CAST(least(people, 6) AS INTEGER), count(*) FROM col GROUP BY 2""")
def name_histograms(spark, d):
    return identity.histograms(_named(spark, d))


_POLICY = f"""{_COLL}, pol AS (SELECT n.CustomerName, hotel_key, {V.placeholder_sql('n.CustomerName')} AS ph, {V.words_sql('n.CustomerName')} AS words, col.people IS NOT NULL AS hit FROM named n LEFT JOIN col ON col.CustomerName = n.CustomerName),
    x AS (SELECT 'all_names' AS policy, CustomerName, hotel_key FROM pol UNION ALL SELECT 'drop_placeholders', CustomerName, hotel_key FROM pol WHERE NOT ph UNION ALL SELECT 'drop_short_le3', CustomerName, hotel_key FROM pol WHERE NOT ph AND length(CustomerName) > 3
    UNION ALL SELECT 'drop_single_token', CustomerName, hotel_key FROM pol WHERE NOT ph AND words >= 2 UNION ALL SELECT 'min_two_tokens_and_no_collision', CustomerName, hotel_key FROM pol WHERE NOT ph AND words >= 2 AND NOT hit),
    u AS (SELECT policy, CustomerName, count(*) AS c FROM x GROUP BY 1, 2), h AS (SELECT policy, count(DISTINCT hotel_key) AS n_hotels FROM x GROUP BY 1), a AS (SELECT count(*) AS n FROM named)"""


@query(f"""WITH {_POLICY} SELECT policy, CAST(sum(c) AS BIGINT) AS n_interactions, count(*) AS n_users, round(avg(c), 2) AS mean_per_user, max(c) AS max_per_user, round(100.0 * avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 4) AS single_pct, count(*) FILTER (WHERE c >= 4) AS eligible_users, max(n_hotels) AS n_hotels,
    round(100.0 * sum(c) / max(n), 4) AS retained_pct, round(100.0 * (1 - sum(c) / (count(*) * CAST(max(n_hotels) AS DOUBLE))), 4) AS sparsity_pct FROM u JOIN h USING (policy) CROSS JOIN a GROUP BY policy""")
def filter_policies(spark, d):
    return identity.sensitivity(_named(spark, d))


# ---- pairs, samples, panels ---------------------------------------------------------------------------------------

_PTOK = rf"list_distinct(list_filter(string_split(regexp_replace(lower({V.plain_sql('name')}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> ''))"
_PAIRS = f"""cat AS (SELECT concat(p_name, ' ', p_brand) AS name, min(p_partkey) AS k FROM part GROUP BY 1), tk AS (SELECT k, {_PTOK} AS t FROM cat), ex AS (SELECT k, len(t) AS n, unnest(t) AS token FROM tk),
    pr AS (SELECT a.k AS a, b.k AS b, round(count(*) / CAST(max(a.n) + max(b.n) - count(*) AS DOUBLE), 4) AS jaccard FROM ex a JOIN ex b ON a.token = b.token AND a.k < b.k GROUP BY 1, 2)"""


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").groupBy(F.concat("p_name", F.lit(" "), "p_brand").alias("name")).agg(F.min("p_partkey").alias("k"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = panel.token_pairs(_catalogue(spark, d), "k", "name")
    return p.select("a", "b", F.round(F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")), 4).alias("jaccard"))


@query(f"WITH {_PAIRS} SELECT * FROM pr")
def pair_jaccard(spark, d):
    return _pairs(spark, d)


_STRATA = _PAIRS + """, st AS (SELECT *, CASE WHEN jaccard = 1 THEN 'merge' WHEN r <= 100 AND jaccard > 0 THEN 'top' WHEN jaccard >= 0.34 THEN 'hard' ELSE 'random' END AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY jaccard = 1 ORDER BY jaccard DESC, a, b) AS r FROM pr)),
    pl AS (SELECT stratum, CASE WHEN stratum = 'random' THEN c + (SELECT count(*) * (count(*) - 1) // 2 FROM cat) - sum(c) OVER () ELSE c END AS pool_size FROM (SELECT stratum, count(*) AS c FROM st GROUP BY 1))"""


def _stratified(spark: SparkSession, d: str) -> DataFrame:
    return panel.strata(_pairs(spark, d).withColumn("merge", F.col("jaccard") == 1), "merge", seq=None)


@query(f"WITH {_STRATA} SELECT stratum, CAST(pool_size AS BIGINT) AS pool_size FROM pl")
def pair_strata(spark, d):
    return panel.pools(_stratified(spark, d), _catalogue(spark, d).count())


_SAMPLE = _STRATA + """, sm AS (SELECT a, b, jaccard, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR), '42')), a, b) AS nr FROM st) WHERE stratum = 'merge' OR nr <= CASE stratum WHEN 'top' THEN 100 ELSE 150 END)"""


@query(f"""WITH {_SAMPLE} SELECT a, b, stratum, printf('P%04d', row_number() OVER (ORDER BY md5(concat_ws('|', concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR)), '42')), concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR))) - 1) AS pair_id FROM sm""")
def pair_sample(spark, d):
    return panel.sample_strata(_stratified(spark, d)).select("a", "b", "stratum", "pair_id")


@query()
def seq_ratio_pairs(spark, d):
    return panel.scored_pairs(_catalogue(spark, d), "k", "name")


_JUDGED = _SAMPLE + """, w AS (SELECT stratum, max(pool_size) / CAST(count(*) AS DOUBLE) AS weight FROM sm JOIN pl USING (stratum) GROUP BY 1), jd AS (SELECT sm.*, weight, stratum = 'merge' AS merged, CASE WHEN jaccard >= 0.5 AND (a + b) % 3 <> 0 THEN 1 ELSE 0 END AS gold FROM sm JOIN w USING (stratum))"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    st = _stratified(spark, d)
    s = panel.sample_strata(st)
    w = panel.stratum_weights(s, panel.pools(st, _catalogue(spark, d).count()))
    g = F.when((F.col("jaccard") >= 0.5) & ((F.col("a") + F.col("b")) % 3 != 0), 1).otherwise(0)
    return s.join(w, "stratum").withColumns({"merged": F.col("stratum") == "merge", "gold": g})


@query(f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (WHERE merged AND gold = 1) AS tp, count(*) FILTER (WHERE merged AND gold = 0) AS fp, count(*) FILTER (WHERE NOT merged AND gold = 1) AS fn, count(*) FILTER (WHERE NOT merged AND gold = 0) AS tn,
    coalesce(sum(weight) FILTER (WHERE merged AND gold = 1), 0) AS tw, coalesce(sum(weight) FILTER (WHERE NOT merged AND gold = 1), 0) AS fw FROM jd), r AS (SELECT tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 4) END AS recall_sample, CASE WHEN tw + fw > 0 THEN round(tw / (tw + fw), 4) END AS recall_weighted FROM c)
    SELECT *, CASE WHEN precision > 0 AND recall_weighted > 0 THEN round(2 * precision * recall_weighted / (precision + recall_weighted), 4) END AS f1 FROM r""")
def ht_recall(spark, d):
    return panel.matcher_score(_judged(spark, d), "merged", "gold", "weight")


@query(f"WITH {_JUDGED}, g AS (SELECT stratum, count(*) AS n, sum(weight) AS mass FROM jd WHERE NOT merged AND gold = 1 GROUP BY 1), h AS (SELECT *, round(mass / sum(mass) OVER (), 4) AS share FROM g) SELECT stratum, n, round(mass, 6) AS mass, share, share > 0.5 AND n <= 3 AS fragile FROM h")
def missed_mass(spark, d):
    return panel.missed_mass(_judged(spark, d), "merged", "gold", "weight").withColumn("mass", F.round("mass", 6))


@query(f"WITH {_JUDGED} SELECT stratum, count(*) AS n, CAST(sum(gold) AS BIGINT) AS positives, round(avg(gold), 4) AS rate FROM jd GROUP BY 1")
def stratum_rates(spark, d):
    return panel.by_stratum(_judged(spark, d), "gold")


@query(f"WITH {_JUDGED} SELECT a, b, concat_ws('+', CASE WHEN merged THEN 'algo_merge' END, CASE WHEN gold = 1 THEN 'panel_positive' END, CASE WHEN (a + b) % 7 = 0 THEN 'contested' END) AS why FROM jd WHERE merged OR gold = 1 OR (a + b) % 7 = 0")
def load_bearing(spark, d):
    return panel.load_bearing(_judged(spark, d), "merged", F.col("gold") == 1, (F.col("a") + F.col("b")) % 7 == 0).select("a", "b", "why")


@query(f"WITH {_JUDGED} SELECT why, count(*) AS n FROM (SELECT concat_ws('+', CASE WHEN merged THEN 'algo_merge' END, CASE WHEN gold = 1 THEN 'panel_positive' END, CASE WHEN (a + b) % 7 = 0 THEN 'contested' END) AS why FROM jd) WHERE why <> '' GROUP BY 1")
def load_bearing_counts(spark, d):
    return panel.reason_counts(load_bearing(spark, d))


_LABELLED = "jl AS (SELECT *, CASE WHEN (a + b) % 11 <> 0 THEN gold END AS label FROM jd)"


@query(f"""WITH {_JUDGED}, {_LABELLED} SELECT stratum, count(*) AS n, count(label) AS labelled, round(count(label) / CAST(count(*) AS DOUBLE), 4) AS coverage, count(*) FILTER (WHERE (a + b) % 7 = 0) AS disputed, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE merged) AS predicted,
    count(*) FILTER (WHERE label = merged::INT) AS correct, round(sum(CASE WHEN label IS NOT NULL THEN weight ELSE 0.0 END), 4) AS weight_labelled FROM jl GROUP BY GROUPING SETS ((), (stratum))""")
def matcher_report(spark, d):
    """Coverage, disputed rows and correct predictions by stratum, some rows unlabelled."""
    j = _judged(spark, d).withColumn("label", F.when((F.col("a") + F.col("b")) % 11 != 0, F.col("gold")))
    return panel.matcher_report(j, "merged", "label", "weight", (F.col("a") + F.col("b")) % 7 == 0)


@query(f"""WITH {_JUDGED}, lb AS (SELECT *, concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS k, concat_ws('+', CASE WHEN merged THEN 'algo_merge' END, CASE WHEN gold = 1 THEN 'panel_positive' END, CASE WHEN (a + b) % 7 = 0 THEN 'contested' END) AS why FROM jd)
    SELECT printf('V%04d', row_number() OVER (ORDER BY md5(concat_ws('|', k, '42')), k) - 1) AS verify_id, k, why FROM lb WHERE why <> ''""")
def verify_key(spark, d):
    """The coordinator's key of the verification packet."""
    return panel.verify_packet(load_bearing(spark, d).withColumn("k", F.concat_ws("|", "a", "b")), "k", ["a", "b"])[1]


@query("""SELECT doc_id, source, lang, CASE lang WHEN 'en' THEN 'Is it English prose?' WHEN 'fr' THEN 'Is it French prose?' ELSE '' END AS question, '' AS answer FROM
    (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS nr FROM documents) WHERE nr <= 5""")
def annotation_sheet(spark, d):
    """A sheet of sampled documents with a question by kind and a blank answer."""
    s = panel.sample_per_group(V.table(spark, d, "documents"), "source", 5, "doc_id")
    return panel.sheet(s, ["doc_id", "source", "lang"], ["answer"], "lang", {"question": {"en": "Is it English prose?", "fr": "Is it French prose?"}})


_LONG = "lb AS (SELECT doc_id, 1 AS annotator, quality AS label FROM labels UNION ALL SELECT doc_id, 2, 1 - toxic FROM labels WHERE doc_id % 4 <> 0)"


@query(f"WITH {_LONG}, g AS (SELECT doc_id, max(CASE WHEN annotator = 1 THEN label END) AS annotator_1, max(CASE WHEN annotator = 2 THEN label END) AS annotator_2, count(label) AS n_labels, min(label) < max(label) AS contested FROM lb GROUP BY 1) SELECT d.doc_id, annotator_1, annotator_2, coalesce(n_labels, 0) AS n_labels, coalesce(contested, false) AS contested FROM documents d LEFT JOIN g USING (doc_id)")
def packet_merge(spark, d):
    lab = V.table(spark, d, "labels")
    rows = lab.select("doc_id", F.lit(1).alias("annotator"), F.col("quality").alias("label")).unionByName(lab.where("doc_id % 4 <> 0").select("doc_id", F.lit(2).alias("annotator"), (1 - F.col("toxic")).alias("label")))
    return panel.merged(V.table(spark, d, "documents").select("doc_id"), rows, "doc_id")


@query("SELECT annotator, doc_id, CAST(row_number() OVER (PARTITION BY annotator ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(annotator + 100 AS VARCHAR))), doc_id) AS INTEGER) AS place FROM labels CROSS JOIN (SELECT unnest([1, 2, 3]) AS annotator)")
def packet_orders(spark, d):
    return panel.packets(V.table(spark, d, "labels"), "doc_id", 3)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS nr FROM documents) WHERE nr <= 5")
def sample_by_source(spark, d):
    return panel.sample_per_group(V.table(spark, d, "documents"), "source", 5, "doc_id").select("doc_id", "source")


@query("SELECT lang AS kind, count(*) AS n, round(avg(quality), 4) AS c1, round(avg(1 - toxic), 4) AS c2, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END), 4) AS all_criteria FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def criteria_pass_rates(spark, d):
    x = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("kind")), "doc_id").select("kind", F.col("quality").alias("c1"), (1 - F.col("toxic")).alias("c2"))
    return panel.pass_rates(x, ["c1", "c2"], "kind")


# ---- sequences and streams ----------------------------------------------------------------------------------------


@query(f"WITH {V.EV} SELECT event_id, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ',') AS prefix, item_id AS next FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1")
def prefix_sequences(spark, d):
    p = sequences.prefixes(V.interactions(spark, d), ["ts", "event_id"], 5, ("event_id",))
    return p.withColumn("prefix", F.array_join(F.transform("prefix", lambda x: x.cast("string")), ","))


@query(f"WITH {V.EV} SELECT user_id, item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM ev QUALIFY next_id IS NOT NULL")
def next_item_pairs(spark, d):
    return sequences.next_items(V.interactions(spark, d), ["ts", "event_id"])


@query(f"""WITH {_FOLDS}, h AS (SELECT user_id, list(item_id ORDER BY ts, item_id, event_id) AS t FROM f WHERE fold = 'train' GROUP BY 1) SELECT h.user_id, array_to_string(list_concat(t, [v.item_id]), ',') AS test_input, v.item_id AS val, x.item_id AS test FROM h JOIN f v ON v.user_id = h.user_id AND v.fold = 'val' JOIN f x ON x.user_id = h.user_id AND x.fold = 'test'""")
def fold_sequences(spark, d):
    f = _folds(spark, d)
    part = lambda x: f.where(F.col("fold") == x)
    s = sequences.fold_sequences(part("train"), part("val"), part("test"), ["ts", "item_id", "event_id"])
    return s.select("user_id", F.array_join(F.transform("test_input", lambda x: x.cast("string")), ",").alias("test_input"), "val", "test")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return live.windowed(V.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, nr""")
def user_sessions(spark, d):
    return live.sessions(V.table(spark, d, "events"))
