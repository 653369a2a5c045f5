"""Candidate pairs of listings, samples for annotators, packets, merging, gold labels, evaluation of a matcher."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..settings import HARD_JACCARD, HARD_SEQ, MIN_RATERS, SEED, STRATA_SIZES


def hash_order(seed: int, *columns: str) -> list[Column]:
    """A pseudo-random order that depends on the rows alone: md5 of the columns and the seed, then the columns."""
    return [F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))), *[F.col(c) for c in columns]]


def sample(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly n rows (or all), uniform without replacement."""
    return df.orderBy(*hash_order(seed, key)).limit(n)


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Up to n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*hash_order(seed, key)))).where(F.col("_n") <= n).drop("_n")


def shuffled(df: DataFrame, key: str, seed: int, label: str, pattern: str) -> DataFrame:
    """df with a label such as P0001 in pseudo-random order."""
    return df.withColumn(label, F.format_string(pattern, F.row_number().over(Window.orderBy(*hash_order(seed, key))) - 1))


def catalogue(df: DataFrame, name: str, city: str, source: str) -> DataFrame:
    """Distinct listings: name, city, platforms (sorted, joined by ' | '), n_inter."""
    return df.groupBy(F.col(name).alias("name"), F.col(city).alias("city")).agg(F.array_join(F.array_sort(F.collect_set(source)), " | ").alias("platforms"), F.count("*").alias("n_inter"))


def token_pairs(listings: DataFrame, key: str, name: str) -> DataFrame:
    """a, b (a < b), inter, na, nb of all pairs that share a name word: an inverted index joined with itself instead of all pairs."""
    t = listings.select(F.col(key).alias("k"), T.name_token_set(F.col(name)).alias("t"))
    x = t.select("k", F.size("t").alias("n"), F.explode("t").alias("token"))
    a, b = x.alias("a"), x.alias("b")
    j = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.k") < F.col("b.k")))
    return j.groupBy(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("inter"))


def scored_pairs(listings: DataFrame, key: str, name: str) -> DataFrame:
    """a, b, jaccard, seq_ratio of pairs that share a word; all others have 0 and 0."""
    p = token_pairs(listings, key, name).withColumn("jaccard", F.round(F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")), 4))
    side = lambda s: listings.select(F.col(key).alias(s), T.strip_accents(F.lower(F.col(name))).alias(f"name_{s}"))
    return p.join(side("a"), "a").join(side("b"), "b").select("a", "b", "jaccard", T.sequence_ratio("name_a", "name_b").alias("seq_ratio"))


def is_hard(jaccard: Column, seq: Column) -> Column:
    return (jaccard >= HARD_JACCARD) | (seq >= HARD_SEQ)


def strata(pairs: DataFrame, merge: str, jaccard: str = "jaccard", seq: str | None = "seq_ratio", top: int = STRATA_SIZES["top"]) -> DataFrame:
    """pairs with `stratum`: merge (the algorithm's), top (the `top` most similar others), hard (above a threshold), random."""
    s = F.col(seq) if seq else F.lit(0.0)
    order = Window.partitionBy(merge).orderBy(F.desc(jaccard), s.desc(), "a", "b")
    r = pairs.withColumn("_r", F.row_number().over(order))
    return r.withColumn("stratum", F.when(F.col(merge), "merge").when((F.col("_r") <= top) & (F.col(jaccard) > 0), "top").when(is_hard(F.col(jaccard), s), "hard").otherwise("random")).drop("_r")


def pools(stratified: DataFrame, n_listings: int) -> DataFrame:
    """stratum, pool_size; pairs that share no word are counted, not made, and belong to random."""
    g = stratified.groupBy("stratum").agg(F.count("*").alias("pool_size"))
    total = n_listings * (n_listings - 1) // 2
    rest = F.lit(total) - F.sum("pool_size").over(Window.partitionBy())
    return g.withColumn("pool_size", F.when(F.col("stratum") == "random", F.col("pool_size") + rest).otherwise(F.col("pool_size")))


def sample_strata(stratified: DataFrame, sizes: dict[str, int] = STRATA_SIZES, seed: int = SEED) -> DataFrame:
    """All of merge and up to sizes[stratum] of the others, labelled P0000 ... in pseudo-random order."""
    w = Window.partitionBy("stratum").orderBy(*hash_order(seed, "a", "b"))
    most = F.lit(None)
    for name, n in sizes.items():
        most = F.when(F.col("stratum") == name, F.lit(n)).otherwise(most)
    s = stratified.withColumn("_n", F.row_number().over(w)).where((F.col("stratum") == "merge") | (F.col("_n") <= most)).drop("_n")
    return shuffled(s.withColumn("_k", F.concat_ws("|", "a", "b")), "_k", seed, "pair_id", "P%04d").drop("_k")


def blind(df: DataFrame, shown: list[str], empty: list[str]) -> DataFrame:
    """The columns that annotators may see and blank ones for their answers."""
    return df.select(*shown).withColumns({c: F.lit("") for c in empty})


def packets(sheet: DataFrame, key: str, annotators: int, first_seed: int = 100) -> DataFrame:
    """annotator, place, key: each annotator's own order of the items."""
    who = sheet.select(F.col(key).alias("key")).withColumn("annotator", F.explode(F.sequence(F.lit(1), F.lit(annotators))))
    order = F.md5(F.concat_ws("|", F.col("key").cast("string"), (F.col("annotator") + first_seed).cast("string")))
    return who.withColumn("place", F.row_number().over(Window.partitionBy("annotator").orderBy(order, "key"))).select("annotator", "place", F.col("key").alias(key))


def rater_columns(columns: list[str]) -> list[str]:
    """annotator_1, annotator_2 ... in numeric order."""
    found = [c for c in columns if c.removeprefix("annotator_").isdigit() and c.startswith("annotator_")]
    return sorted(found, key=lambda c: int(c.removeprefix("annotator_")))


def merged(sheet: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """sheet with annotator_i from (key, annotator, label) rows, n_labels, and contested where they differ."""
    who = [r[0] for r in labels.select("annotator").distinct().orderBy("annotator").collect()]
    wide = labels.groupBy(key).agg(*[F.max(F.when(F.col("annotator") == i, F.col("label"))).alias(f"annotator_{i}") for i in who], F.count("label").alias("n_labels"), (F.min("label") < F.max("label")).alias("contested"))
    return sheet.join(wide, key, "left").withColumns({"n_labels": F.coalesce("n_labels", F.lit(0)), "contested": F.coalesce("contested", F.lit(False))})


def overlay(*labels: Column) -> Column:
    """The first label there is: verification before audit, adjudication and majority."""
    return F.coalesce(*labels)


def gold(raters: list[str], adjudicated: str | None = None, least: int = MIN_RATERS) -> Column:
    """The adjudicated label, else the strict majority of `least` raters or more, else null."""
    ones = sum((F.coalesce((F.col(r) == 1).cast("int"), F.lit(0)) for r in raters), F.lit(0))
    zeros = sum((F.coalesce((F.col(r) == 0).cast("int"), F.lit(0)) for r in raters), F.lit(0))
    vote = F.when((ones + zeros >= least) & (ones > zeros), 1).when((ones + zeros >= least) & (zeros > ones), 0)
    return F.coalesce(F.col(adjudicated), vote) if adjudicated else vote


def load_bearing(df: DataFrame, merge: str, positive: Column, contested: Column) -> DataFrame:
    """Rows that the evaluation rests on, `why` joined by +: the algorithm merges them, the panel does, or it disagrees."""
    why = F.concat_ws("+", F.when(F.col(merge), "algo_merge"), F.when(positive, "panel_positive"), F.when(contested, "contested"))
    return df.withColumn("why", why).where(F.col("why") != "")


def reason_counts(bearing: DataFrame) -> DataFrame:
    """why, n: how many rows each combination of reasons holds."""
    return bearing.groupBy("why").agg(F.count("*").alias("n"))


def matcher_report(df: DataFrame, predicted: str, truth: str, weight: str, contested: Column) -> DataFrame:
    """stratum (null: all), n, labelled, coverage, disputed, positives, predicted, correct, weight_labelled: what stands behind a matcher's score.

    coverage: labelled over all rows; disputed: rows on which raters differ;
    correct: labelled rows whose prediction is the label; weight_labelled: rows
    of the pool that the labelled ones stand for.
    """
    known = F.col(truth).isNotNull()
    parts = [
        F.count("*").alias("n"), F.count_if(known).alias("labelled"), F.round(F.count_if(known) / F.count("*"), 4).alias("coverage"), F.count_if(contested).alias("disputed"),
        F.count_if(known & (F.col(truth) == 1)).alias("positives"), F.count_if(F.col(predicted)).alias("predicted"), F.count_if(known & (F.col(predicted).cast("int") == F.col(truth))).alias("correct"),
        F.round(F.sum(F.when(known, F.col(weight)).otherwise(0.0)), 4).alias("weight_labelled"),
    ]
    return df.groupingSets([[], [F.col("stratum")]], F.col("stratum")).agg(*parts)


def sheet(df: DataFrame, shown: list[str], empty: list[str], kind: str, literals: dict[str, dict[str, str]]) -> DataFrame:
    """A sheet for annotators: the columns shown, blank answers, and for each literal column the text of the row's kind, '' for others."""
    texts = {}
    for c, by_kind in literals.items():
        text = F.lit("")
        for k, v in by_kind.items():
            text = F.when(F.col(kind) == k, v).otherwise(text)
        texts[c] = text
    return blind(df.withColumns(texts), [*shown, *texts], empty)


def verify_packet(bearing: DataFrame, key: str, shown: list[str], seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The blind packet (verify_id, columns shown, blank answer) and the coordinator's key (verify_id, key, why), in pseudo-random order."""
    order = shuffled(bearing, key, seed, "verify_id", "V%04d")
    return blind(order, ["verify_id", *shown], ["answer"]), order.select("verify_id", key, "why")


def audit_sample(df: DataFrame, key: str, unanimous_negative: Column, bearing: DataFrame, n: int, seed: int = 59) -> DataFrame:
    """n unanimous negatives that are not load-bearing."""
    return sample(df.where(unanimous_negative).join(bearing.select(key), key, "left_anti"), n, key, seed)


def agreement(df: DataFrame, raters: list[str]) -> DataFrame:
    """a, b, n, agreement, kappa of every two raters: answers in long form joined by item."""
    d = df.withColumn("_i", F.monotonically_increasing_id()) if "_i" not in df.columns else df
    out = None
    for i, a in enumerate(raters):
        for b in raters[i + 1 :]:
            one = S.cohens_kappa(d, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "agreement", "kappa")
            out = one if out is None else out.unionByName(one)
    return out


def unanimity(df: DataFrame, raters: list[str]) -> DataFrame:
    """n, unanimous, to_adjudicate of the rows that all raters labelled."""
    full = df.dropna(subset=raters)
    same = F.array_min(F.array(*raters)) == F.array_max(F.array(*raters))
    return full.agg(F.count("*").alias("n"), F.count_if(same).alias("unanimous"), F.count_if(~same).alias("to_adjudicate"))


def stratum_weights(sampled: DataFrame, pool: DataFrame) -> DataFrame:
    """stratum, weight: pool size over number sampled."""
    n = sampled.groupBy("stratum").agg(F.count("*").alias("n_sampled"))
    return pool.join(n, "stratum").select("stratum", (F.col("pool_size") / F.col("n_sampled")).alias("weight"))


def matcher_score(df: DataFrame, predicted: str, truth: str, weight: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, sample and weighted recall, F1 with the latter."""
    p, t = F.col(predicted).cast("int"), F.col(truth)
    d = df.where(t.isNotNull())
    cell = lambda a, b: F.count_if((p == a) & (t == b))
    mass = lambda a: F.sum(F.when((p == a) & (t == 1), F.col(weight)).otherwise(0.0))
    c = d.agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"), mass(1).alias("tw"), mass(0).alias("fw"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    c = c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall_sample": share(F.col("tp"), F.col("tp") + F.col("fn")), "recall_weighted": share(F.col("tw"), F.col("tw") + F.col("fw"))})
    return c.drop("tw", "fw").withColumn("f1", T.f1(F.col("precision"), F.col("recall_weighted")))


def missed_mass(df: DataFrame, predicted: str, truth: str, weight: str) -> DataFrame:
    """stratum, n, mass, share, fragile of missed matches: fragile where over half of the mass rests on 3 rows or fewer."""
    g = df.where(~F.col(predicted) & (F.col(truth) == 1)).groupBy("stratum").agg(F.count("*").alias("n"), F.sum(weight).alias("mass"))
    return g.withColumn("share", F.round(F.col("mass") / F.sum("mass").over(Window.partitionBy()), 4)).withColumn("fragile", (F.col("share") > 0.5) & (F.col("n") <= 3))


def by_stratum(df: DataFrame, truth: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull()).groupBy("stratum").agg(F.count("*").alias("n"), F.sum(truth).cast("long").alias("positives"), F.round(F.avg(truth), 4).alias("rate"))


def pass_rates(df: DataFrame, criteria: list[str], kind: str) -> DataFrame:
    """kind (null: all), n, the rate of each 0/1 criterion and of all together, by grouping sets."""
    every = F.least(*[F.col(c) for c in criteria]) if len(criteria) > 1 else F.col(criteria[0])
    rates = [F.round(F.avg(c), 4).alias(c) for c in criteria]
    return df.withColumn("_all", (every == 1).cast("int")).groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count("*").alias("n"), *rates, F.round(F.avg("_all"), 4).alias("all_criteria"))


def rule_of_three(n: Column) -> Column:
    """Upper 95 % bound of a rate of which n trials showed none."""
    return F.when(n > 0, F.round(F.least(F.lit(1.0), 3.0 / n), 4))


def human_against_panel(df: DataFrame, human: str, panel: str) -> DataFrame:
    """n, agreement, kappa of human and panel labels, and rows where the human differs."""
    both = df.where(F.col(human).isNotNull() & F.col(panel).isNotNull())
    return S.cohens_kappa(both, human, panel).crossJoin(both.agg(F.count_if(F.col(human) != F.col(panel)).alias("differ")))


def provenance(studies: DataFrame, human_verified: str, llm_slots: str) -> DataFrame:
    """studies with `status`: manual (no model slot), verified (models, checked by a human), provisional."""
    return studies.withColumn("status", F.when(F.col(llm_slots) == 0, "manual").when(F.col(human_verified), "verified").otherwise("provisional"))


def record_criteria(records: DataFrame, interactions: DataFrame, mapping: DataFrame | None, rating: str = "rating", lo: float = 0.0, hi: float = 10.0, date_lo: str = "2010-01-01", date_hi: str = "2024-12-31") -> DataFrame:
    """records (record_id, record_type, user_id, hotel_id, rating, date, name) with 0/1 criteria.

    c1: fields are valid; c2: the interaction is in the released table (user,
    hotel, rating to 4 decimals, date), or the hotel has one; c3: the user is in
    the private mapping under a real name (none without a mapping), or the hotel
    has a type or a key left.
    """
    is_hotel = F.col("record_type") == "hotel"
    keys = interactions.select("user_id", "hotel_id", F.round("rating", 4).alias("_r"), F.col("date").cast("string").alias("_d")).distinct().withColumn("_in", F.lit(True))
    r = records.withColumns({"_r": F.round(rating, 4), "_d": F.col("date").cast("string")}).join(keys, ["user_id", "hotel_id", "_r", "_d"], "left")
    r = r.join(interactions.select("hotel_id").distinct().withColumn("_has", F.lit(True)), "hotel_id", "left")
    if mapping is None:
        r = r.withColumn("_real", F.lit(False))
    else:
        known = mapping.groupBy("user_id").agg(F.bool_or(~T.is_placeholder(F.col("CustomerName"))).alias("_real"))
        r = r.join(known, "user_id", "left")
    ok = F.col(rating).between(lo, hi) & F.col("date").cast("date").between(F.lit(date_lo).cast("date"), F.lit(date_hi).cast("date")) & ~T.is_blank(F.col("user_id")) & ~T.is_blank(F.col("hotel_id"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return r.withColumns({
        "c1": F.when(is_hotel, flag(~T.is_blank(F.col("name")))).otherwise(flag(ok)), "c2": F.when(is_hotel, flag(F.col("_has"))).otherwise(flag(F.col("_in"))),
        "c3": F.when(is_hotel, flag(T.canonical_key(F.col("name")) != "")).otherwise(flag(F.col("_real"))),
    }).select(*records.columns, "c1", "c2", "c3")


#: Studies by name: the columns shown and a filter of their rows.
STUDIES: dict[str, tuple[list[str], Callable[[DataFrame], Column]]] = {
    "er_pairs": (["pair_id", "name_a", "city_a", "platforms_a", "name_b", "city_b", "platforms_b"], lambda df: F.lit(True)),
    "qc_hotels": (["record_id", "hotel_id", "name", "location"], lambda df: F.col("record_type") == "hotel"),
}


def study_rows(df: DataFrame, study: str) -> DataFrame:
    if study not in STUDIES:
        raise ValueError(f"{study} is none of {', '.join(STUDIES)}")
    shown, rule = STUDIES[study]
    return df.where(rule(df)).select(*shown)
