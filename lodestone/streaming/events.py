"""Streams of interactions: duplicates within a watermark, windowed counts, upserts of batches, running statistics of users.

Additions of this library: the batch operators are its main form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark where it is a stream; times without a zone are taken in the session's."""
    if not events.isStreaming:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def first_only(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return _timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, the `by` columns, n and total of tumbling or sliding windows; works on batches too."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    d = _timed(events, ts, late)
    return d.groupBy(win.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    d = _timed(events, ts, late)
    return d.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_users(events: DataFrame) -> DataFrame:
    """user_id, n, mean: running count and mean of value, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, mean double", "n long, total double", "update", "NoTimeout")


def upsert_sink(events: DataFrame, path: str, key: str, checkpoint: str):
    """Write each batch as a version of its keys under path; read back with latest()."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of each key's last batch."""
    d = spark.read.option("basePath", path).parquet(path)
    last = d.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return d.join(last, [key, "_batch"], "left_semi").drop("_batch")
