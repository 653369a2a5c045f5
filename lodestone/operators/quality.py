"""Quality control of interaction tables: completeness, ranges, duplicates, the clean table, its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DATE_MAX, DATE_MIN, RATING_MAX, RATING_MIN


def completeness(df: DataFrame, columns: list[str], placeholder_column: str | None = None) -> DataFrame:
    """column, present, n_missing, missing_pct for each wanted column, in one pass; columns that df lacks are not present.

    Missing is null or blank, and a placeholder in the placeholder column.
    """
    have = [c for c in columns if c in df.columns]
    missing = [F.count_if(T.is_blank(F.col(c).cast("string")) | (T.is_placeholder(F.col(c)) if c == placeholder_column else F.lit(False))) for c in have]
    one = df.agg(F.count("*").alias("n"), F.array(*missing).alias("m")) if have else df.agg(F.count("*").alias("n")).withColumn("m", F.array().cast("array<long>"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), (F.col("m")[have.index(c)] if c in have else F.lit(None).cast("long")).alias("n_missing")) for c in columns])
    return one.select("n", F.inline(rows)).select("column", "present", "n_missing", F.when(F.col("present"), T.percent(F.col("n_missing"), F.col("n"))).alias("missing_pct"))


def typed(df: DataFrame, rating: str = "Rating", date: str = "Date") -> DataFrame:
    """With Rating_clean (double) and Date_parsed (date); what does not parse is null."""
    return df.withColumns({"Rating_clean": T.repaired_number(F.col(rating)), "Date_parsed": T.parsed_date(F.col(date))})


def out_of_range(value: Column, lo, hi) -> Column:
    return (value < F.lit(lo)) | (value > F.lit(hi))


def range_report(df: DataFrame, rating: str = "Rating_clean", date: str = "Date_parsed") -> DataFrame:
    """One row: invalid ratings (null or out of range), unparsed and out-of-window dates, least, greatest and mean values."""
    r, d = F.col(rating), F.col(date)
    return df.agg(
        F.count("*").alias("n"), F.count_if(r.isNull() | out_of_range(r, RATING_MIN, RATING_MAX)).alias("bad_rating"), F.count_if(d.isNull()).alias("unparsed_date"),
        F.count_if(out_of_range(d, F.lit(DATE_MIN).cast("date"), F.lit(DATE_MAX).cast("date"))).alias("date_out_of_window"),
        F.min(r).alias("min_rating"), F.max(r).alias("max_rating"), F.round(F.avg(r), 6).alias("mean_rating"), F.min(d).cast("string").alias("min_date"), F.max(d).cast("string").alias("max_date"),
    )


def duplicate_flags(df: DataFrame, keys: list[str], order: list[str], flag: str = "is_dup") -> DataFrame:
    """True on all rows of a key but the first in `order`; null keys are equal to each other."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join in which no key may repeat on either side: a repeated one stops the query with an error that names it.

    The check rides on the join: each side carries the number of rows of its
    key, from the same partial aggregation that the join's shuffle would deal.
    """
    def checked(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        g = df.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
        key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on])
        error = F.raise_error(F.concat(F.lit(f"key repeats on the {side} side: "), key))
        return g.withColumn(on[0], F.when(F.col("_n") > 1, error.cast(df.schema[on[0]].dataType)).otherwise(F.col(on[0]))).drop("_n")

    return checked(left, "left").join(checked(right, "right"), on, how)


def clean(df: DataFrame, keys: list[str], order: list[str], name: str = "CustomerName", rating: str = "Rating_clean", date: str = "Date_parsed") -> DataFrame:
    """Rows with a rating in range, a date, a real name, and not an exact duplicate; near duplicates stay."""
    flagged = duplicate_flags(df, keys, order, "_dup")
    good = F.col(rating).between(RATING_MIN, RATING_MAX) & ~F.isnan(rating) & F.col(date).isNotNull() & ~T.is_placeholder(F.col(name)) & ~F.col("_dup")
    return flagged.where(good).drop("_dup")


def several_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n: keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])
