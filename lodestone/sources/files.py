"""Scans and sinks: CSV, JSON, JSON lines, Markdown, keyed caches, fold files."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a raw site file, read as text; the aliases are spellings found in such files.
RAW = ("CustomerName", "Address", "NameHotel", "Rating", "Date")
ALIASES = {"Address": "Location", "Ratting": "Rating"}
FOLD = "userID int, itemID int, rating double, timestamp long"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; all columns are text unless a schema is given. A byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def repaired_header(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Column names without white space around them, and by their usual spelling."""
    return df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(aliases)


def load_sites(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All site files as one frame, `source` naming the site; columns that a site lacks are null."""
    out = None
    for site, path in paths.items():
        one = repaired_header(read_csv(spark, path)).withColumn("source", F.lit(site))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no site files")
    return out


def load_fold(spark: SparkSession, folder: str, fold: str, folds: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One fold of a split; an unknown name raises ValueError."""
    if fold not in folds:
        raise ValueError(f"{fold} is none of {', '.join(folds)}")
    return read_csv(spark, f"{folder}/{fold}.csv", FOLD)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; `single` makes one part file, for small exports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small frame as one file with a byte-order mark, as spreadsheets want it; more than `most` rows raise ValueError."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_cache(spark: SparkSession, path: str, schema: str, key: str = "id", order: str = "ts") -> DataFrame:
    """The last record of each key of JSON lines; blank and broken lines are skipped."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    good = raw.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *[F.col(c).desc() for c in good.columns if c not in (key, order)])
    return good.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def append_cache(df: DataFrame, path: str, key: str | None = None, schema: str | None = None) -> None:
    """Append records as JSON lines; with a key and the cache's schema only those whose key it does not hold, so that a repeated call adds nothing."""
    if key is not None:
        df = df.dropDuplicates([key])
        if exists(df.sparkSession, path):
            df = df.join(read_cache(df.sparkSession, path, schema, key).select(key), key, "left_anti")
    df.write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def find_folder(spark: SparkSession, start: str, wanted: str, levels: int = 4) -> str:
    """The folder `wanted` in `start` or in the nearest of its parents, `levels` up at most; FileNotFoundError where there is none."""
    at = start.rstrip("/")
    for _ in range(levels + 1):
        if exists(spark, f"{at}/{wanted}"):
            return f"{at}/{wanted}"
        if "/" not in at.split("://")[-1]:
            break
        at = at.rsplit("/", 1)[0]
    raise FileNotFoundError(f"no {wanted} in {start} or above")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows but for the keys that are new, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_present(frames: Iterable[DataFrame], key: str, value: str) -> DataFrame:
    """key, value: of several sources the first that has a value for the key."""
    out = None
    for rank, f in enumerate(frames):
        one = f.where(F.col(value).isNotNull()).select(key, value, F.lit(rank).alias("_r"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by(value, "_r").alias(value))


def markdown(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A small frame as a Markdown table; nulls are dashes. More than `most` rows raise ValueError."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = io.StringIO()
    out.write("| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
    for r in rows:
        out.write("| " + " | ".join(show(v) for v in r) + " |\n")
    return out.getvalue()


def write_markdown(sections: dict[str, DataFrame], path: str, digits: int = 4) -> None:
    """A report of headed tables on the driver."""
    Path(path).write_text("".join(f"## {title}\n\n{markdown(df, digits)}\n" for title, df in sections.items()), encoding="utf-8")


def cached_embeddings(df: DataFrame, path: str, text: str, encoder: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """df with an `embedding` column, kept as Parquet at path and used again while encoder, texts and number of rows agree.

    Each version has a folder of its own, named by a digest of the encoder and
    of all texts, so none is overwritten while it may be read.
    """
    spark = df.sparkSession
    n, mix = df.agg(F.count("*"), F.bit_xor(F.xxhash64(text, F.lit(encoder)))).first()
    path = f"{path.rstrip('/')}/{n}-{(mix or 0) & (2**64 - 1):016x}"
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path).drop("encoder")

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(encode([x or "" for x in t]))

    df.withColumn("embedding", run(F.col(text))).withColumn("encoder", F.lit(encoder)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("encoder")
