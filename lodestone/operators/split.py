"""Temporal leave-one-out splits, dense ids, fold statistics, relevance filters, corpus characterisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..settings import MIN_INTERACTIONS, SEED


def at_least(df: DataFrame, key: str, k: int = MIN_INTERACTIONS) -> DataFrame:
    """Rows of keys with k rows or more, by a semi-join with the counted keys."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= k).select(key), key, "left_semi")


def dense_ids(df: DataFrame, key: str, alias: str) -> DataFrame:
    """key and 0, 1, 2 ... for its distinct values in order."""
    d = df.select(key).where(F.col(key).isNotNull()).distinct()
    return d.withColumn(alias, F.row_number().over(Window.orderBy(key)) - 1)


def temporal_folds(df: DataFrame, user: str, order: list, k: int = MIN_INTERACTIONS) -> DataFrame:
    """df with `fold`: each user's last row is test, the one before val, the others train. order: columns that fix the order within a user."""
    w = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    back = F.row_number().over(w)
    return at_least(df, user, k).withColumn("_b", back).withColumn("fold", F.when(F.col("_b") == 1, "test").when(F.col("_b") == 2, "val").otherwise("train")).drop("_b")


def random_folds(df: DataFrame, user: str, key: list[str], k: int = MIN_INTERACTIONS, seed: int = SEED) -> DataFrame:
    """The same with each user's rows in an order by hash: one test row, one val row."""
    mixed = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return temporal_folds(df.withColumn("_h", mixed), user, ["_h", *key], k).drop("_h")


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, so that no later fold repeats a pair."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def relevant(df: DataFrame, least: float, rating: str = "rating") -> DataFrame:
    """All train rows and the val and test rows rated `least` or more."""
    return df.where((F.col("fold") == "train") | (F.col(rating) >= least))


def fold_stats(df: DataFrame, user: str, item: str, ts: str, rating: str = "rating") -> DataFrame:
    return df.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_distinct(user).alias("users"), F.count_distinct(item).alias("items"),
        F.min(ts).cast("date").cast("string").alias("first_day"), F.max(ts).cast("date").cast("string").alias("last_day"), F.round(F.avg(rating), 6).alias("mean_rating"),
    )


def characterise(df: DataFrame, user: str, item: str, rating: str = "rating") -> DataFrame:
    """One row: sizes, sparsity, means and deviations, single-interaction users, Gini and head share of items."""
    per_user = df.groupBy(user).agg(F.count("*").alias("c"), F.sum(rating).alias("s"), F.sum(F.col(rating) * F.col(rating)).alias("q"))
    u = per_user.agg(F.count("*").alias("n_users"), F.sum("c").alias("n"), F.round(F.avg("c"), 6).alias("mean_per_user"), F.percentile("c", F.lit(0.5)).alias("median_per_user"), F.round(100.0 * F.avg((F.col("c") == 1).cast("double")), 4).alias("single_pct"))
    r = df.agg(F.round(F.avg(rating), 6).alias("mean_rating"), F.round(F.stddev_samp(rating), 6).alias("sd_rating"))
    items = df.groupBy(item).agg(F.count("*").alias("c"))
    i = items.agg(F.count("*").alias("n_items"))
    g, h = S.gini(items, "c").select("gini"), S.head_share(items, "c").select("n_head", F.col("share_pct").alias("head_pct"))
    # five frames of one row each
    one = u.crossJoin(r).crossJoin(i).crossJoin(g).crossJoin(h)
    return one.withColumn("sparsity_pct", F.round(100.0 * (1 - F.col("n") / (F.col("n_users") * F.col("n_items"))), 4))


def min_k_sweep(df: DataFrame, user: str, item: str, ks: tuple[int, ...] = (2, 3, 4, 5, 8)) -> DataFrame:
    """min_k, n, users, items: what is left if users need min_k rows; one scan for all."""
    per = df.groupBy(user).agg(F.count("*").alias("c"))
    d = df.select(user, item).join(per, user).withColumn("min_k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("c") >= F.col("min_k"))
    return d.groupBy("min_k").agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"), F.count_distinct(item).alias("items"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, width: float) -> DataFrame:
    """bin (0, 1, ...), n: of width `width` in [lo, hi], the last bin closed; values outside are left out."""
    last = round((hi - lo) / width) - 1
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(last)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def clipped_counts(df: DataFrame, key: str, most: int) -> DataFrame:
    """rows, keys: how many keys have so many rows, `most` standing for all above."""
    return df.groupBy(key).agg(F.count("*").alias("c")).groupBy(F.least("c", F.lit(most)).cast("int").alias("rows")).agg(F.count("*").alias("keys"))


def protocols(df: DataFrame, user: str, order: list[str], key: list[str], k: int = MIN_INTERACTIONS, seed: int = SEED) -> dict[str, DataFrame]:
    """The folds of both protocols, temporal and random, for an ablation."""
    return {"temporal": temporal_folds(df, user, order, k), "random": random_folds(df, user, key, k, seed)}


def resolution_effect(df: DataFrame, raw: str, resolved: str, user: str) -> DataFrame:
    """resolution (on, off), n, items, mean_per_item, pairs: the table with items by resolved and by raw key; pairs are distinct user-item pairs."""
    x = df.select(user, F.inline(F.array(F.struct(F.lit("on").alias("resolution"), F.col(resolved).alias("item")), F.struct(F.lit("off").alias("resolution"), F.col(raw).alias("item")))))
    g = x.groupBy("resolution", user, "item").agg(F.count("*").alias("c")).groupBy("resolution").agg(F.sum("c").alias("n"), F.count_distinct("item").alias("items"), F.count("*").alias("pairs"))
    return g.select("resolution", "n", "items", F.round(F.col("n") / F.col("items"), 4).alias("mean_per_item"), "pairs")
