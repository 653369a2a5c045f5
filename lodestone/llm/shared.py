"""Helpers that several corpus operators share: scratch tables, word patterns, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII space and the controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Scratch folders of local sessions without spark.checkpoint.dir, and the scratch tables written so far, by application.
_FOLDERS: dict[str, str] = {}
_TABLES: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is used, which is right only for a
    local master; on a cluster that raises ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _FOLDERS:
            _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
        folder = _FOLDERS[context.applicationId]
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never what an
    earlier step wrote. `dropped` deletes such a table, `clear` all of a session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete scratch tables that `written` returned, once all that was made of them is written itself."""
    for t in tables:
        path = getattr(t, "_scratch", None) if t is not None else None
        if path:
            spark = t.sparkSession
            remove(spark, path)
            _TABLES.get(spark.sparkContext.applicationId, set()).discard(path)


def tables(spark: SparkSession) -> set[str]:
    """Paths of this session's scratch tables."""
    return set(_TABLES.get(spark.sparkContext.applicationId, ()))


def clear(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete this session's scratch tables but for `keep`. Results of the operators read some of them, so write those first."""
    for path in tables(spark) - keep:
        remove(spark, path)
        _TABLES[spark.sparkContext.applicationId].discard(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def without(docs: DataFrame, gone: DataFrame, same: Column, key: Column, gone_key: Column, bits: int = 24) -> DataFrame:
    """The rows of `docs` (known as d) that have no match in `gone` (known as g) by the condition `same`; few rows with texts are dealt.

    key, gone_key: non-null longs of either side, equal where rows match. A table of
    2^bits marks, a bit for each key of `gone`, goes to all tasks (2^(bits - 6)
    numbers at most, whatever the input). Rows without a mark stay where they
    lie; those with one, some of them by chance, are joined with `gone`.
    """
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(1 << bits))
    word = lambda c: F.shiftright(place(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    marks = gone.alias("g").groupBy(word(gone_key).alias("__word")).agg(F.bit_or(bit(gone_key)).alias("__bits"))
    marks = written(marks, "marks")
    met = docs.alias("d").join(F.broadcast(marks).alias("m"), word(key) == F.col("m.__word"), "left")  # bounded, as said above
    marked = F.coalesce(F.col("m.__bits").bitwiseAND(bit(key)) != 0, F.lit(False))
    rest = met.where(marked).select("d.*").alias("d").join(gone.alias("g"), same, "left_anti")
    return met.where(~marked).select("d.*").unionAll(rest)


def released() -> None:
    """Give what this Python worker has freed back to the system, as it may stay idle beside other tasks for a while."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lowered(text):
    """A-Z to a-z and nothing else; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(edges: DataFrame, name: str = "components", limit: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b), a written table: rows (node, component), component the least node.

    Alternating large-star and small-star steps: each is a grouping by node and
    a join with its result, so the number of rounds grows with the logarithm of
    the longest chain. A hub's neighbour list is never collected: both steps take
    the least neighbour by a partial aggregate and join it back. A node with one
    neighbour takes no part in the rounds; it gives its neighbour its number,
    and takes its component from it in the end, in a join of two plain tables
    that AQE can split where a hub has many of them. Self-links count for
    nothing; links may repeat and point either way. Nodes without a link do not
    appear; no links, no rows. Null ends are an error of the caller. Raises
    RuntimeError if `limit` rounds do not suffice.
    """
    every = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    if every.isEmpty():
        return every.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = every.select("u", "v").unionByName(every.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # leaves: one neighbour only; of two that have each other the larger is the leaf
    once = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")
    once = written(once, f"{name}-once")
    mutual = once.select(F.col("v").alias("u"), F.col("u").alias("v"))
    leaves = written(once.join(mutual.where("u < v"), ["u", "v"], "left_anti").select(F.col("u").alias("leaf"), F.col("v").alias("hub")), f"{name}-leaves")
    core = every.join(leaves.select(F.col("leaf").alias("u")), "u", "left_anti").join(leaves.select(F.col("leaf").alias("v")), "v", "left_anti")
    e = written(core.select("u", "v"), name)
    while not e.isEmpty():
        limit -= 1
        if limit < 0:
            raise RuntimeError("components did not settle")
        # large-star: every larger neighbour of u, and u itself, points to the least of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small-star: every smaller neighbour of u, and u itself, points to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(e)
        e = after
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    # core nodes and their roots, then hubs without core links, which are their own
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    found = written(found, name)
    members = leaves.select(F.col("leaf").alias("node"), "hub").join(found.select(F.col("node").alias("hub"), "root"), "hub", "left").select("node", F.coalesce("root", "hub").alias("root"))
    hubs = leaves.select(F.col("hub").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    rooted = written(union_all([found, members, hubs]), name)
    top = written(rooted.groupBy("root").agg(F.min("node").alias("component")), name)
    out = written(rooted.join(top, "root").select("node", "component"), name)
    dropped(every, once, leaves, e, found, rooted, top)
    return out


def sorted_groups(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows sorted by key as frames of whole groups, and True with parts of groups that have more than `most` different rows."""
    held: list[pd.DataFrame] = []
    big = None  # key of the large group that is passing
    for pdf in batches:
        key = pdf["key"].to_numpy()
        if big is not None:
            n = int((key == big).sum())
            if n:
                yield pdf.iloc[:n], True
            pdf, key = pdf.iloc[n:], key[n:]
            if len(pdf):
                big = None
        if not len(pdf):
            continue
        start = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if start or held and held[-1]["key"].iloc[-1] != key[0]:
            yield pd.concat([*held, pdf.iloc[:start]]) if held else pdf.iloc[:start], False
            held = []
        held.append(pdf.iloc[start:])
        if sum(map(len, held)) > 4 * most:
            held = [pd.concat(held).drop_duplicates()]
            if len(held[0]) > most:
                yield held[0], True
                held, big = [], key[-1]
    if held:
        yield pd.concat(held), False


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted by `key`, for sorted_groups."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
