"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by their length and first bytes, then the groups that still
hold two or more are split by the next bytes, and so on, until a group is a
single document or its text has ended. Digits are byte strings that widen from
level to level, so a text of n bytes takes O(log n) levels. Texts are compared
byte by byte through these digits; no digest takes part in the decision.

Every split is a partial aggregate by (group, digit), so a group that holds a
third of all rows becomes one row a task before the shuffle. The members learn
their new group from a join with the groups of two or more, whose skew AQE can
split, as both of its sides are plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, dropped, lowered, union_all, written


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 64, growth: int = 8, carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and with `carry` the struct `row` of the input's columns.

    Two texts are equal when they are identical after A-Z are lower-cased; null
    counts as empty, so null and empty texts are equal. Of a group the row with
    the largest id stays; null ids are the smallest. Of rows that tie, as they
    repeat both id and text, exactly one is kept. Very long texts are compared to
    their last byte. Other columns may have any names. An empty table gives an
    empty result.

    first, growth: bytes of the first digit, and by how much digits widen.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.translate(F.substring(text, 1, first), UPPER, LOWER).cast("binary")  # as many characters have as many bytes at least
    body = lowered(F.col(text_col)).cast("binary")
    bytes_ = F.octet_length(text).cast("long")
    groups = _groups(docs.select(bytes_.alias("n"), F.substring(head, 1, first).alias("digit")), "n")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [body.alias("body")]
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), bytes_.alias("n"), F.substring(head, 1, first).alias("digit"), F.unhex(F.sha2(body, 256)).alias("sha"), *whole,
    )
    level, width, done, scratch, tables = 0, first, [], [groups], ["id", "uid", "sha", *(["row"] if carry else [])]
    rows = rows.join(groups.hint("merge"), ["n", "digit"], "left")
    if carry:  # one text is dealt, not two
        rows = rows.withColumn("body", lowered(F.col(f"row.`{text_col}`")).cast("binary"))
    while True:
        live = F.col("label").isNotNull() & (F.col("n") > width)
        rest = F.when(live, F.expr(f"substring(body, {width + 1})"))
        table = written(rows.select(*tables, "label", "size", live.alias("live"), (F.col("n") - width).alias("n"), rest.alias("body")), f"radix{level}")
        dropped(*scratch)
        done.append(table.where("not live").select(*tables, F.lit(level).alias("level"), "label", "size"))
        left = table.where("live")
        if left.isEmpty():
            break
        level, width = level + 1, width * growth
        left = left.select(*tables, F.col("label").alias("parent"), "n", "body", F.substring("body", 1, width).alias("digit"))
        scratch = [_groups(left.select("parent", "digit"), "parent")]
        rows = left.join(scratch[0].hint("merge"), ["parent", "digit"], "left")
    ended = union_all(done)
    alone = ended.where("label is null").select(*tables, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    copies = ended.where("label is not null")
    top = written(copies.groupBy("level", "label").agg(F.max(F.struct("id", "uid")).alias("top")), "radix-top")
    copies = copies.join(top, ["level", "label"]).select(*tables, F.col("top.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("uid") == F.col("top.uid")).alias("kept"))
    out = alone.unionByName(copies)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), *(["row"] if carry else []))


def _groups(digits: DataFrame, parent: str) -> DataFrame:
    """The groups of two or more, each with a label of its own."""
    many = digits.groupBy(parent, "digit").agg(F.count("*").alias("size")).where("size > 1")
    return written(many.withColumn("label", F.monotonically_increasing_id()), "radix-groups")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all columns: one of each group of equal texts."""
    out = radix_groups(docs, id_col, text_col, carry=True).where("kept")
    return out.select("row.*")
