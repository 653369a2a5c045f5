"""Mixing sources to target weights by a low-discrepancy schedule.

The total of the mix is shared among sources by weight, with a cap on how often
a source may repeat (`targets`). The mix is a sequence of slots of equal size:
slot t is mapped from the golden-ratio point frac(t * phi), worked out in 64-bit
integers so that it is exact for any t, through the sources' cumulative targets, so every prefix of the sequence holds the sources in
proportion within O(log t) slots. A source's k-th slot takes block k of that
source, whose documents stand in a fixed pseudo-random order and are cut into
blocks of `block` words, the same at every size of the input; after its last word the source starts again. Its last
block ends with its target. `mix` gives the slots of each document's words, and
`mixed_documents` the documents in order of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, dropped, written

#: 2^64 over the golden ratio.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame, text_col: str = "text"):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(names: list, size: np.ndarray, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> np.ndarray:
    """Each source's target: `share` of all sizes by weight, none above `most` times its size.

    What a cap cuts off is shared again by weight among the sources that are not
    at their cap, until none is above. names: in code-point order, null last.
    """
    n = len(names)
    w = np.array([weights[i % len(weights)] for i in range(n)], float)
    cap = most * size.astype(float)
    target, open_, left = np.zeros(n), np.ones(n, bool), share * float(size.sum())
    while open_.any():
        want = left * w / w[open_].sum()
        over = open_ & (want > cap)
        if not over.any():
            target[open_] = want[open_]
            break
        target[over] = cap[over]
        left -= float(cap[over].sum())
        open_ &= ~over
    return target


def schedule(spark, target: np.ndarray, slots: int) -> DataFrame:
    """The golden-ratio slots as rows (slot, src, rank): src the source's number, rank counted from 0 within it, in slot order. target: whole words by source.

    Ranks come from counts per range of slots and running sums over them, so no
    task ranks all slots of a source.
    """
    total = int(target.sum())
    # source i owns the points below edges[i] and not below edges[i - 1], in units of 2^-64
    edges = np.array([min((1 << 64) - 1, (int(c) << 64) // total) for c in np.cumsum(target.astype("int64"))], "u8")

    @F.pandas_udf("int")
    def source_of(t: pd.Series) -> pd.Series:
        point = t.to_numpy().astype("u8") * GOLDEN
        return pd.Series(np.minimum(np.searchsorted(edges, point, "right"), len(edges) - 1).astype("int32"))

    part = F.floor(F.col("slot") / 8192)
    s = spark.range(slots).select(F.col("id").alias("slot")).withColumn("src", source_of(F.col("slot"))).withColumn("part", part)
    before = s.groupBy("src", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("src").orderBy("part")) - F.col("count")).drop("count")
    ranked = s.withColumn("k", F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1)
    return ranked.join(before, ["src", "part"]).select("slot", "src", (F.col("before") + F.col("k")).alias("rank"))


def words_of_targets(target: np.ndarray, size: np.ndarray, most: float = 2.0) -> np.ndarray:
    """Whole words that each source gives: its target, rounded, and not above `most` times its size."""
    return np.minimum(np.floor(target + 0.5), np.floor(most * size)).astype("int64")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1_024, bucket_rows: int = 2_000, max_sources: int = 100_000) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, first_pass, second_pass (words of each pass, from the front of the text), and first_from, first_to, second_from, second_to.

    The last four are the slots of the mix in which the passes' words begin and
    end, null where a pass takes none. A source's words, one pass after the
    other, are cut into blocks of as many words, and block k stands in the
    source's k-th slot.

    taken = first_pass + second_pass and is at most `most` (2 at most) times the
    size. Null and empty texts have size 0 and are taken 0 times; a null source
    is a source, the last. Equal rows are separate documents; null ids are ids.
    The order within a source is a hash of the id (ties: id, size, a hash of the
    text), so reruns agree whatever the partitions. Whole texts are counted,
    very long ones too, and no text is moved. Columns of the input may have any
    names. An empty table gives an empty result.

    A source's last block is as short as its target needs, so each source gives
    its target to the nearest word, those with targets below a block too.

    block: words of a block; the number of slots grows with the input.
    Sources' totals (a name and a number each) go to the driver: more than
    max_sources of them raise ValueError.
    """
    base, placed, slots_of, _, _ = _placed(docs, id_col, text_col, source_col, weights, share, most, block, bucket_rows, max_sources, [])
    out = _with_slots(placed, slots_of, block).select(
        F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        (F.col("first_pass") + F.col("second_pass")).alias("taken"), "first_pass", "second_pass", *ENDS,
    )
    dropped(base)
    return out


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, most: float, block: int, bucket_rows: int, max_sources: int, row: list) -> tuple[DataFrame, DataFrame, DataFrame | None, int, int]:
    """The rows by uid (with the columns `row`), the words that each gives and their place, the schedule, and the numbers of slots and of words of the mix."""
    if most > 2:
        raise ValueError("a source is passed over twice at most")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes(docs, text_col).alias("size"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("uid"), *row)
    # rows are known by uid from here on, so that texts are not moved where places are worked out
    base = written(base, "mix-sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    known = per.limit(max_sources + 1).toPandas()
    if len(known) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    known = known.astype({"source": object})
    known.loc[known["source"].isna(), "source"] = None
    rows = sorted(known.to_dict("records"), key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    size = np.array([r["source_size"] for r in rows], "int64")
    target = targets([r["source"] for r in rows], size, weights, share, most) if rows else np.zeros(0)
    words = words_of_targets(target, size, most)
    need = -(-words // block)
    n_slots = int(need.sum())
    have = np.zeros(len(rows), "int64")
    slots_of = None
    if n_slots:
        slots_of = written(schedule(spark, words, n_slots), "mix-slots")
        for r in slots_of.groupBy("src").agg((F.max("rank") + 1).alias("n")).collect():
            have[r["src"]] = min(r["n"], need[r["src"]])
    # blocks that the schedule's points leave over, few for each source, stand behind its slots
    late = n_slots + np.cumsum(need - have) - (need - have)
    total_slots = n_slots + int((need - have).sum())
    info = [(r["source"], i, int(size[i]), float(target[i]), int(words[i]), int(have[i]), int(late[i])) for i, r in enumerate(rows)]
    sources = spark.createDataFrame(info, "source string, src int, source_size long, target double, words long, have long, late long")
    buckets = max(1, int(sum(r["rows"] for r in rows) // bucket_rows))
    # at most max_sources small rows, counted above
    placed = base.drop("row").join(F.broadcast(sources), base["source"].eqNullSafe(sources["source"])).drop("source")
    placed = placed.withColumn("key", F.xxhash64("id", F.lit(1))).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("words_in"))
    before = sums.select("src", "bucket", (F.sum("words_in").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words_in")).alias("before"))
    inner = Window.partitionBy("src", "bucket").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("start", F.sum("size").over(inner) - F.col("size")).join(before, ["src", "bucket"]).withColumn("place", F.col("start") + F.col("before"))
    within = lambda x: F.greatest(F.lit(0), F.least(x - F.col("place"), F.col("size"))).cast("long")
    placed = placed.withColumns({"first_pass": within(F.col("words")), "second_pass": within(F.col("words") - F.col("source_size"))})
    placed = written(placed.select("uid", "id", "size", "src", "source_size", "target", "have", "late", "place", "first_pass", "second_pass"), "mix-places")
    return base, placed, slots_of, total_slots, int(words.sum())


ENDS = ("first_from", "first_to", "second_from", "second_to")


def _with_slots(placed: DataFrame, slots_of: DataFrame | None, block: int) -> DataFrame:
    """`placed` and the slots of the blocks in which a document's passes begin and end; the second pass goes on where the first one ends."""
    if slots_of is None:
        return placed.select("*", *[F.lit(None).cast("long").alias(c) for c in ENDS])
    again = F.col("place") + F.col("source_size")
    spots = {"first_from": F.col("place"), "first_to": F.col("place") + F.col("first_pass") - 1, "second_from": again, "second_to": again + F.col("second_pass") - 1}
    some = F.filter(
        F.array(*[F.struct(F.lit(c).alias("end"), F.col("first_pass" if c.startswith("first") else "second_pass").alias("n"), F.floor(at / block).cast("long").alias("rank")) for c, at in spots.items()]), lambda x: x["n"] > 0,
    )
    asked = placed.select("uid", "src", "have", "late", F.inline(some))
    found = asked.join(slots_of.hint("merge"), ["src", "rank"], "left").withColumn("slot", F.when(F.col("rank") < F.col("have"), F.col("slot")).otherwise(F.col("late") + F.col("rank") - F.col("have")))
    found = found.groupBy("uid").agg(*[F.max(F.when(F.col("end") == c, F.col("slot"))).alias(c) for c in ENDS])
    return placed.join(found.hint("merge"), "uid", "left")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1_024, bucket_rows: int = 2_000, max_sources: int = 100_000, words_per_part: int = 4_000_000, max_parts: int = 100_000) -> DataFrame:
    """`docs` as the mix takes them, in order of the slots in which they begin: a row for each pass over a document, its text cut after the words taken.

    A document in both passes appears twice; only the last document of a pass
    over a source can be cut. Rows that the mix takes no word of do not appear.
    Where docs has n_chars, it is set anew for cut texts. Nulls, ties, repeated
    rows and empty tables are as in `mix`.

    Partition k holds the k-th of equal ranges of slots, in order, with about
    words_per_part words (more beyond max_parts partitions). This depends on the
    rows only, not on how they are partitioned, so what is written is the same
    in every run. Texts are moved twice, to their slots' places and into order.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]
    base, placed, slots_of, n_slots, n_words = _placed(docs, id_col, text_col, source_col, weights, share, most, block, bucket_rows, max_sources, row)
    given = written(_with_slots(placed.where("first_pass + second_pass > 0"), slots_of, block).select("uid", "size", "source_size", "place", "first_pass", "second_pass", "first_from", "second_from"), "mix-given")
    dropped(placed, slots_of)
    m = given.join(base.select("uid", "row").hint("merge"), "uid")
    passes = [F.struct(F.col("first_pass").alias("words"), F.col("first_from").alias("slot"), F.col("place").alias("at")), F.struct(F.col("second_pass").alias("words"), F.col("second_from").alias("slot"), (F.col("place") + F.col("source_size")).alias("at"))]
    m = m.select("size", "row", F.inline(F.filter(F.array(*passes), lambda x: x["words"] > 0)))
    # documents that begin in one slot are of one source, in its order
    parts = max(1, min(max_parts, -(-n_words // words_per_part)))
    part = F.floor(F.col("slot") * F.lit(parts) / F.lit(max(1, n_slots))).cast("int")
    m = m.repartitionById(parts, part).sortWithinPartitions("slot", "at")
    whole = F.col("words") == F.col("size")
    # the text up to the end of word number `words`: split keeps words only, so the end is found by the pieces before it
    pieces = F.expr(f"regexp_extract_all(row.`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    front = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(whole, F.col("row." + text_col)).otherwise(front)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(text.alias(c))
        elif c == "n_chars":
            cols.append(F.when(whole, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return m.select(*cols)
