"""The library's relations as views of the available tables, in Spark and, for the twins, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating, ts, source, event_id of events."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item_id"), F.col("value").alias("rating"), "ts", F.col("event_type").alias("source"), "event_id")


EV = "ev AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, value AS rating, ts, event_type AS source, event_id FROM events)"

#: Columns that fix the order of raw reviews.
SEQ = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# the two engines read these alike
_NAME = """CASE WHEN c_custkey % 37 = 0 THEN 'Không tên' WHEN c_custkey % 41 = 0 THEN 'N/A' WHEN c_custkey % 43 = 0 THEN 'Lý' WHEN c_custkey % 5 = 0 THEN c_mktsegment
    WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, ' A. B.') ELSE concat(c_mktsegment, ' ', n_name, ' ', CAST(c_custkey % 40 AS {s})) END"""
_HOTEL = """concat(CASE WHEN p_partkey % 3 = 0 THEN 'Khách sạn ' ELSE '' END, p_name, CASE p_size % 4 WHEN 0 THEN ' Hotel' WHEN 1 THEN ' Resort & Spa' WHEN 2 THEN ' Villa' ELSE '' END)"""
_RATING = """CASE WHEN l_linenumber = 7 THEN concat(CAST(CAST(l_quantity AS INT) % 10 AS {s}), '..5') WHEN l_linenumber = 6 AND l_partkey % 9 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) % 13 AS {s}) END"""
_DATE = "concat(CAST(year(o_orderdate) + 17 AS {s}), {day})"
_JOIN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"


def _select(s: str, day: str) -> str:
    return f"{_NAME} AS CustomerName, {_HOTEL} AS NameHotel, concat('Đà ', p_brand) AS Location, {_RATING} AS Rating, {_DATE} AS Date, o_orderpriority AS source, {', '.join(SEQ)}".replace("{s}", s).replace("{day}", day)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews as a crawl would give them: names with placeholders, ratings and dates as text."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    exprs = {
        "CustomerName": _NAME, "NameHotel": _HOTEL, "Location": "concat('Đà ', p_brand)", "Rating": _RATING, "Date": _DATE, "source": "o_orderpriority",
    }
    return d.select(*[F.expr(e.replace("{s}", "STRING").replace("{day}", "date_format(o_orderdate, '-MM-dd')")).alias(k) for k, e in exprs.items()], *SEQ)


RAW = f"raw AS (SELECT {_select('VARCHAR', chr(39).join(['strftime(o_orderdate, ', '-%m-%d', ')']))} FROM {_JOIN})"
TYPED = RAW + ", typed AS (SELECT *, TRY_CAST(replace(trim(Rating), '..', '.') AS DOUBLE) AS Rating_clean, TRY_CAST(Date AS DATE) AS Date_parsed FROM raw)"


def plain_sql(x: str) -> str:
    return f"replace(replace(strip_accents(coalesce({x}, '')), 'đ', 'd'), 'Đ', 'D')"


def folded_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({plain_sql(x)}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def place_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({plain_sql(x)}), '\s+', ' ', 'g'))"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({folded_sql(x)}, ' '), lambda t: t <> '' AND t NOT IN ({_list(T.STOPWORDS)}))"


def joined_sql(tokens: str) -> str:
    return f"array_to_string(list_sort(list_distinct({tokens})), ' ')"


def key_sql(x: str) -> str:
    return joined_sql(tokens_sql(x))


def discriminative_sql(x: str, city: str) -> str:
    rest = f"list_filter({tokens_sql(x)}, lambda u: NOT list_contains(string_split({place_sql(city)}, ' '), u))"
    return f"CASE WHEN len({rest}) > 0 THEN {joined_sql(rest)} ELSE {key_sql(x)} END"


def type_sql(x: str) -> str:
    cases = ", ".join(rf"CASE WHEN regexp_matches({folded_sql(x)}, '\b{m}\b') THEN '{label}' END" for m, label in T.TYPE_MARKERS)
    found = f"list_distinct(list_filter([{cases}], lambda t: t IS NOT NULL))"
    return f"CASE WHEN len({found}) = 1 THEN ({found})[1] ELSE 'unspecified' END"


def placeholder_sql(x: str) -> str:
    return rf"({folded_sql(x)} IN ({_list(T.PLACEHOLDERS)}) AND NOT ({folded_sql(x)} = '' AND regexp_matches(coalesce({x}, ''), '[\p{{L}}\p{{N}}]')))"


def words_sql(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda t: t <> ''))"
