"""Statistics over DataFrames: concentration, resampling, paired tests, rater agreement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..settings import BOOT_ALPHA, N_BOOT, SEED


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row (n, gini): (n + 1 - 2 * sum of cumulated shares) / n; 0 for no rows or a zero sum.

    Values are grouped first, so the running sums go over distinct values.
    """
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # of c equal values v after `before` of them with sum s: the cumulated sums add up to c*s + v*c*(c+1)/2
    parts = g.select("v", "c", F.coalesce(F.sum(F.col("v") * F.col("c")).over(w), F.lit(0.0)).alias("s"))
    area = F.sum(F.col("c") * F.col("s") + F.col("v") * F.col("c") * (F.col("c") + 1) / 2)
    total, n = F.sum(F.col("v") * F.col("c")), F.coalesce(F.sum("c"), F.lit(0))
    return parts.agg(n.alias("n"), F.coalesce(F.round((n + 1 - 2 * area / F.nullif(total, F.lit(0.0))) / F.nullif(n, F.lit(0)), 6), F.lit(0.0)).alias("gini"))


def lorenz(df: DataFrame, value: str, steps: int = 10) -> DataFrame:
    """step, share: the share of the total that the smallest step / steps of the rows hold."""
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    r = df.select(F.row_number().over(Window.orderBy(value)).alias("i"), F.sum(value).over(w).alias("cum"), F.sum(value).over(all_).alias("total"), F.count("*").over(all_).alias("n"))
    r = r.withColumn("step", F.ceil(F.col("i") * steps / F.col("n")).cast("int"))
    return r.groupBy("step").agg(F.round(F.max(F.col("cum") / F.col("total")), 6).alias("share"))


def head_share(df: DataFrame, value: str, head: float = 0.2) -> DataFrame:
    """One row (n_head, share_pct): what the ceil(head * n) largest hold of the total."""
    all_ = Window.partitionBy()
    r = df.select(value, F.row_number().over(Window.orderBy(F.desc(value))).alias("i"), F.ceil(F.lit(head) * F.count("*").over(all_)).alias("k"))
    top = F.sum(F.when(F.col("i") <= F.col("k"), F.col(value)).otherwise(0))
    return r.agg(F.max("k").cast("long").alias("n_head"), F.round(100.0 * top / F.sum(value), 4).alias("share_pct"))


def bootstrap_ci(df: DataFrame, group: str, value: str, n_boot: int = N_BOOT, alpha: float = BOOT_ALPHA, seed: int = SEED, order: str | None = None) -> DataFrame:
    """group, mean, lo, hi, n: percentile interval of the mean under resampling of rows, in one task a group.

    Rows are taken in `order`, so a rerun draws the same. For groups beyond a
    task's memory use poisson_bootstrap.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = (pdf.sort_values(order) if order else pdf)[value].dropna().to_numpy(float)
        name = pdf[group].iloc[0]
        if not len(x):
            return pd.DataFrame([(name, None, None, None, 0)], columns=["g", "mean", "lo", "hi", "n"])
        rng, step = np.random.default_rng(seed), max(1, 4_000_000 // len(x))
        means = np.concatenate([x[rng.integers(0, len(x), (min(step, n_boot - k), len(x)))].mean(1) for k in range(0, n_boot, step)])
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([(name, x.mean(), lo, hi, len(x))], columns=["g", "mean", "lo", "hi", "n"])

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(run, f"g {kind}, mean double, lo double, hi double, n long").withColumnRenamed("g", group)


def poisson_bootstrap(df: DataFrame, group: str, value: str, key: str, n_boot: int = 200, alpha: float = BOOT_ALPHA, seed: int = SEED) -> DataFrame:
    """The same interval for any number of rows: each row has a Poisson(1) weight a replicate, from a hash of its key."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    u = F.pmod(F.xxhash64(key, "rep", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    weight = F.lit(0)
    for c in cuts:
        weight = weight + (u >= float(c)).cast("int")
    reps = df.where(F.col(value).isNotNull()).select(group, key, value, F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep")).withColumn("w", weight)
    means = reps.groupBy(group, "rep").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.groupBy(group).agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).join(ends, group)


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def wilcoxon(pairs: DataFrame, group: str, a: str, b: str, least: int = 10) -> DataFrame:
    """group, n_pos, n_neg, n_zero, statistic, p, mean_diff: signed-rank test of a - b with average ranks and tie correction.

    Zeros are dropped; fewer than `least` other differences give a null p. The
    ranks come from counts per distinct difference, so no group is sorted whole.
    """
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, F.round(F.col(a) - F.col(b), 12).alias("d"))
    sizes = d.groupBy(group, F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    ties = sizes.where("m > 0")
    before = F.coalesce(F.sum("t").over(Window.partitionBy(group).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("rank", before + (F.col("t") + 1) / 2)
    s = ranked.groupBy(group).agg(
        F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("wp"), F.sum(F.col("rank") * F.col("down")).alias("wm"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("tie"), F.sum("up").alias("n_pos"), F.sum("down").alias("n_neg"),
    )
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    stat = F.least("wp", "wm")
    s = s.select(group, "n_pos", "n_neg", stat.alias("statistic"), F.when((n >= least) & (var > 0), (stat - mean) / F.sqrt(var)).alias("z"))
    means = d.groupBy(group).agg(F.avg("d").alias("mean_diff"), F.count_if(F.col("d") == 0).alias("n_zero"))
    return means.join(s, group, "left").select(group, F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), "n_zero", "statistic", F.when(F.col("z").isNotNull(), _two_sided("z")).alias("p"), "mean_diff")


def kappa(agree: Column, pa: Column, pb: Column) -> Column:
    """Cohen's kappa from the share of agreement and each rater's share of ones; null where agreement by chance is certain."""
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when(chance < 1, F.round((agree - chance) / F.nullif(1 - chance, F.lit(0.0)), 4))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two 0/1 raters over the rows that both labelled."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("o"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    return r.select("n", F.round("o", 4).alias("agreement"), kappa(F.col("o"), F.col("pa"), F.col("pb")).alias("kappa"))


def fleiss_kappa(df: DataFrame, raters: list[str]) -> DataFrame:
    """n (rows that all raters labelled), kappa; null where agreement by chance is certain."""
    k = len(raters)
    ones = sum((F.col(r).cast("double") for r in raters[1:]), F.col(raters[0]).cast("double"))
    full = df.dropna(subset=raters).select(ones.alias("ones"))
    agree = (F.col("ones") * (F.col("ones") - 1) + (k - F.col("ones")) * (k - F.col("ones") - 1)) / (k * (k - 1))
    r = full.agg(F.count("*").alias("n"), F.avg(agree).alias("o"), (F.sum("ones") / (k * F.count("*"))).alias("p"))
    chance = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return r.select("n", F.when(chance < 1, F.round((F.col("o") - chance) / F.nullif(1 - chance, F.lit(0.0)), 4)).alias("kappa"))
