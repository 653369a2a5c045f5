"""Masked ranking metrics with one held-out item a user, history buckets, parameter grids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..settings import CUTOFFS


def target_ranks(scores: DataFrame, seen: DataFrame, targets: DataFrame, items: DataFrame, by: list[str] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """user_id, item_id, rank, masked of each target, by counting: 1 + the unseen items that stand before it.

    Better scores stand first, equal ones in order of the item. Items without a
    score row score 0 and are counted by arithmetic, not made. A target that the
    user has seen is masked: it ranks behind all unseen items, among the masked
    ones in order of the item, and is no hit. by: further columns of scores (a
    setting), each ranked apart; settings: their values, where known. The scores
    are worked out once and dealt once, by user.
    """
    by = by or []
    place = items.select("item_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("item_id")) - 1)
    n_items = place.agg(F.count("*").alias("n_items"))
    mark = seen.select("user_id", "item_id", F.lit(True).alias("is_seen"))
    t = targets.select("user_id", "item_id").join(mark, ["user_id", "item_id"], "left").join(place, "item_id", "left")
    t = t.select("user_id", F.col("item_id").alias("target"), F.coalesce("is_seen", F.lit(False)).alias("masked"), "place")
    s = t.join(seen.select("user_id", "item_id"), "user_id", "left").groupBy("user_id", "target", "masked", "place").agg(F.count("item_id").alias("n_seen"), F.count_if(F.col("item_id") < F.col("target")).alias("seen_before"))
    if by:
        s = s.crossJoin(settings if settings is not None else scores.select(*by).distinct())  # a grid given by the caller
    x = scores.where(F.col("score").isNotNull()).select("user_id", "item_id", "score", *by).join(mark, ["user_id", "item_id"], "left").join(t.select("user_id", "target"), "user_id")
    own = F.max(F.when(F.col("item_id") == F.col("target"), F.col("score"))).over(Window.partitionBy("user_id", *by))
    x = x.withColumns({"ts": F.coalesce(own, F.lit(0.0)), "free": F.col("is_seen").isNull()})
    before = F.col("item_id") < F.col("target")
    better = (F.col("score") > F.col("ts")) | ((F.col("score") == F.col("ts")) & before)
    g = x.groupBy("user_id", *by).agg(F.max("ts").alias("ts"), F.count_if(F.col("free") & better).alias("above"), F.count_if("free").alias("scored"), F.count_if(F.col("free") & before).alias("scored_before"))
    g = s.join(g, ["user_id", *by], "left").fillna(0, ["ts", "above", "scored", "scored_before"]).crossJoin(n_items)  # n_items has one row
    rest = F.when(F.col("ts") > 0, F.lit(0)).when(F.col("ts") == 0, F.col("place") - F.col("seen_before") - F.col("scored_before")).otherwise(F.col("n_items") - F.col("n_seen") - F.col("scored"))
    rank = F.when(F.col("masked"), F.col("n_items") - F.col("n_seen") + 1 + F.col("seen_before")).otherwise(1 + F.col("above") + rest)
    return g.select(*by, "user_id", F.col("target").alias("item_id"), rank.cast("long").alias("rank"), "masked")


def static_ranks(item_scores: DataFrame, seen: DataFrame, targets: DataFrame, items: DataFrame) -> DataFrame:
    """target_ranks for scores (item_id, score) that are the same for every user, without a row for each user and item.

    A target's rank is its place among all items less the user's seen items
    that stand before it. Items without a score have 0. Only seen rows meet
    users; the items themselves are numbered in one task.
    """
    scored = items.select("item_id").distinct().join(item_scores.select("item_id", "score"), "item_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    place = scored.select("item_id", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).alias("place"))
    n_items = place.agg(F.count("*").alias("n_items"))
    had = seen.select("user_id", "item_id").distinct().join(place, "item_id").select("user_id", F.col("item_id").alias("had"), F.col("place").alias("had_place"))
    t = targets.select("user_id", F.col("item_id").alias("target")).join(place.withColumnRenamed("item_id", "target"), "target", "left").join(had, "user_id", "left")
    own = F.col("had") == F.col("target")
    g = t.groupBy("user_id", "target", "place").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("masked"), F.count("had").alias("n_seen"), F.count_if(F.col("had_place") < F.col("place")).alias("before"), F.count_if(F.col("had") < F.col("target")).alias("seen_before"))
    rank = F.when(F.col("masked"), F.col("n_items") - F.col("n_seen") + 1 + F.col("seen_before")).otherwise(F.col("place") - F.col("before"))
    return g.crossJoin(n_items).select("user_id", F.col("target").alias("item_id"), rank.cast("long").alias("rank"), "masked")  # n_items has one row


def per_user(ranks: DataFrame, ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """ranks with mrr and, for each cutoff, hit, map, ndcg, p and r."""
    cols = {"mrr": 1.0 / F.col("rank")}
    for k in ks:
        hit = (~F.col("masked") & (F.col("rank") <= k)).cast("double")
        cols |= {f"map_{k}": hit / F.col("rank"), f"ndcg_{k}": hit / F.log2(F.col("rank") + 1.0), f"p_{k}": hit / k, f"r_{k}": hit}
    return ranks.withColumns(cols)


def _names(ks: tuple[int, ...]) -> list[str]:
    return ["mrr", *[f"{m}_{k}" for k in ks for m in ("map", "ndcg", "p", "r")]]


def metrics(ranks: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """n_users and the mean of each metric to 4 decimals, over all or by columns of ranks."""
    return per_user(ranks, ks).groupBy(*(by or [])).agg(F.count("*").alias("n_users"), *[F.round(F.avg(c), 4).alias(c) for c in _names(ks)])


def over_seeds(results: DataFrame, method: str, ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Mean and population deviation of each metric over the seeds of a method."""
    return results.groupBy(method).agg(*[x for c in _names(ks) for x in (F.round(F.avg(c), 4).alias(c), F.round(F.stddev_pop(c), 4).alias(f"{c}_sd"))])


def bucket(n: Column) -> Column:
    """History buckets: 2, 3-4, 5-10, and 11+ with everything else."""
    return F.when(n == 2, "2").when(n.between(3, 4), "3-4").when(n.between(5, 10), "5-10").otherwise("11+")


def by_history(ranks: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """bucket, n_users, recall, ndcg, mrr by the number of the user's train rows; empty buckets have zeros."""
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    d = per_user(ranks, (k,)).join(n, "user_id", "left").withColumn("bucket", bucket(F.coalesce("n", F.lit(0))))
    g = d.groupBy("bucket").agg(F.count("*").alias("n_users"), F.avg(f"r_{k}").alias("recall"), F.avg(f"ndcg_{k}").alias("ndcg"), F.avg("mrr").alias("mrr"))
    every = ranks.sparkSession.createDataFrame([("2",), ("3-4",), ("5-10",), ("11+",)], "bucket string")
    zero = [F.coalesce(F.round(c, 4), F.lit(0.0)).alias(c) for c in ("recall", "ndcg", "mrr")]
    return every.join(g, "bucket", "left").select("bucket", F.coalesce("n_users", F.lit(0)).cast("long").alias("n_users"), *zero)


def best_setting(results: DataFrame, metric: str, order: str) -> DataFrame:
    """The row of the greatest metric (rounded as it is); of equal ones the first in `order`."""
    return results.orderBy(F.desc(metric), order).limit(1)


def chosen(results: DataFrame, setting: str, metric: str = "r_10") -> DataFrame:
    """One row (setting): the setting of the greatest metric, rounded as it is, in a grid's results; of equal ones the first in order."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(setting).alias("s")))
    return results.agg(best.alias("x")).select(F.col("x.s").alias(setting))


def tuned(val_ranks: DataFrame, scores: Callable[[DataFrame], DataFrame], test_ranks: Callable[[DataFrame], DataFrame], setting: str, metric: str = "r_10") -> DataFrame:
    """Chosen on the val fold, tested once: the setting and the test metrics of its scores.

    val_ranks: ranks of all settings on the val fold; scores: the scores of the
    one setting, from a frame of one row; test_ranks: ranks of scores on the
    test fold. No other setting meets the test fold.
    """
    best = chosen(metrics(val_ranks, [setting]), setting, metric)
    return best.crossJoin(metrics(test_ranks(scores(best))))  # one row each


def sweep_by_history(ranks: DataFrame, rows: DataFrame, setting: str, k: int = 10) -> DataFrame:
    """setting, bucket, n_users, recall: the grid's ranks by the number of the user's train rows; empty buckets do not appear."""
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    d = per_user(ranks, (k,)).join(n, "user_id", "left").withColumn("bucket", bucket(F.coalesce("n", F.lit(0))))
    return d.groupBy(setting, "bucket").agg(F.count("*").alias("n_users"), F.round(F.avg(f"r_{k}"), 4).alias("recall"))


def best_settings(sweep: DataFrame, setting: str, bucket_: str, n: int = 8) -> DataFrame:
    """The n settings of the greatest recall in one bucket, then over all users: setting, bucket_recall, recall."""
    total = F.sum(F.col("recall") * F.col("n_users")) / F.sum("n_users")
    g = sweep.groupBy(setting).agg(F.max(F.when(F.col("bucket") == bucket_, F.col("recall"))).alias("bucket_recall"), F.round(total, 4).alias("recall"))
    return g.orderBy(F.desc_nulls_last("bucket_recall"), F.desc("recall"), setting).limit(n)


def pairwise(ranks: dict[str, DataFrame], against: str, metric: str = "mrr") -> DataFrame:
    """method, against, n_pos, n_neg, n_zero, statistic, p, mean_diff: the signed-rank test of every other method against one."""
    both = [paired(r, ranks[against], metric).withColumn("method", F.lit(m)) for m, r in ranks.items() if m != against]
    return S.wilcoxon(reduce(DataFrame.unionByName, both), "method", "a", "b").withColumn("against", F.lit(against))


def interval_table(ranks: dict[str, DataFrame], metric: str = "r_10", **options) -> DataFrame:
    """method, mean, lo, hi, n, text: bootstrap intervals of a metric's mean for each method, and as text such as 0.1291 [0.1065, 0.1529]."""
    every = reduce(DataFrame.unionByName, [per_user(r).select("user_id", F.col(metric).alias("value"), F.lit(m).alias("method")) for m, r in ranks.items()])
    ci = S.bootstrap_ci(every, "method", "value", order="user_id", **options)
    return ci.withColumn("text", T.interval_text(F.col("mean"), F.col("lo"), F.col("hi")))


def paired(a: DataFrame, b: DataFrame, metric: str, ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """user_id, a, b: one metric of two rankings for the users of both."""
    pick = lambda d, name: per_user(d, ks).select("user_id", F.col(metric).alias(name))
    return pick(a, "a").join(pick(b, "b"), "user_id")
