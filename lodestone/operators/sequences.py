"""Sequences of a user's items: prefixes, next items, padded histories, negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SEED


def histories(df: DataFrame, order: list[str]) -> DataFrame:
    """user_id, items: each user's items in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col("item_id").alias("_item"))))
    return df.groupBy("user_id").agg(F.transform(rows, lambda r: r["_item"]).alias("items"))


def padded(items, length: int, pad=0):
    """The last `length` items, `pad` before them."""
    last = F.slice(items, F.greatest(F.size(items) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(pad).cast("long"), length - F.size(last)), last.cast("array<long>"))


def prefixes(df: DataFrame, order: list[str], length: int, keep: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """The columns `keep`, prefix (up to `length` items before), next: one row for each item but a user's first."""
    w = Window.partitionBy("user_id").orderBy(*order)
    d = df.select(*keep, F.collect_list("item_id").over(w.rowsBetween(-length, -1)).alias("prefix"), F.col("item_id").alias("next"))
    return d.where(F.size("prefix") > 0)


def next_items(df: DataFrame, order: list[str]) -> DataFrame:
    """user_id, item_id, next_id for all items but a user's last."""
    w = Window.partitionBy("user_id").orderBy(*order)
    return df.select("user_id", "item_id", F.lead("item_id").over(w).alias("next_id")).where("next_id is not null")


def fold_sequences(train: DataFrame, val: DataFrame, test: DataFrame, order: list[str]) -> DataFrame:
    """user_id, train, val_input, test_input, val, test of the users in all three folds: the val item is in the test history."""
    t = histories(train, order).withColumnRenamed("items", "train")
    one = lambda d, n: d.select("user_id", F.col("item_id").alias(n))
    return t.join(one(val, "val"), "user_id").join(one(test, "test"), "user_id").select("user_id", "train", F.col("train").alias("val_input"), F.concat("train", F.array("val")).alias("test_input"), "val", "test")


def negatives(rows: DataFrame, items: DataFrame, pairs: DataFrame | None, per: int = 1, seed: int = SEED) -> DataFrame:
    """rows with a pseudo-random item `negative` (per of them); with pairs, those that the user has are left out."""
    n = items.select("item_id").distinct().withColumn("_p", F.row_number().over(Window.orderBy("item_id")) - 1)
    size = n.agg(F.count("*").alias("_n"))
    d = rows.crossJoin(size).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per))))
    d = d.withColumn("_p", F.pmod(F.xxhash64("user_id", "item_id", "_k", F.lit(seed)), F.col("_n")))
    d = d.join(n.withColumnRenamed("item_id", "negative"), "_p").drop("_p", "_n", "_k")
    if pairs is not None:
        d = d.join(pairs.select("user_id", F.col("item_id").alias("negative")), ["user_id", "negative"], "left_anti")
    return d
