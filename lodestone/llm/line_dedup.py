"""Near-duplicate lines by a segment-partition edit join.

Two lines within `edits` edits share, exactly, one of edits + 1 even segments of
the shorter at nearly the same place of the longer. So each line enters its
segments in an index under (length, segment number, segment), and probes, for
each length down to `edits` less than its own, the substrings that the
multi-match-aware windows leave: 5, 4 and 3 of them for 2 edits. Rows are dealt
by the hash of such a key; index and probe rows that meet make candidates.

A key under which more than `crowd` rows meet makes no pairs. Its lines agree on
a segment, so what is left of them on both sides differs by `edits` at most:
these remainders are grouped within the key by the same step, and the whole
lines of each group are compared in memory, up to `room` rows at once. Larger ones are cut
into blocks first, and each two blocks compared, so no task holds more. Within
such a group, lines whose letter counts differ too much are passed over,
and only links that join lines not yet joined are kept, since a group of m lines
needs m - 1 of them.

Candidates are confirmed by a banded bit-parallel edit distance, worked out for
thousands of pairs at once, one column of all their tables a step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, components, dealt, dropped, sorted_groups, union_all, written


#: Base of the polynomial hash modulo 2^64, odd, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64, by doubling."""
    out = np.ones(max(1, n), "u8")
    done, step = 1, base
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


def keyed(texts: list[str], roles: np.ndarray, edits: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, key, role, start, end) of all rows of `texts`, as arrays: index rows (role 1), probe rows (2) and both (3).

    A key is a hash of group, length and number of the segment, and segment. A
    probe for strings shorter by d looks for segment i of theirs, which starts at
    p, from max(p - i, p + d - (edits - i)) to min(p + i, p + d + edits - i).
    Strings too short to be cut all meet under one key. Substrings are hashed by
    differences of a polynomial hash's prefix sums: equal ones have equal
    hashes, and a chance hit is only a candidate more.
    """
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    first = np.cumsum(size) - size
    sums = np.zeros(len(flat) + 1, "u8")
    np.cumsum((spread(flat + np.uint64(1))) * powers(_BASE, len(flat)), out=sums[1:])
    back = powers(_INVERSE, len(flat) + 1)
    seeds = np.zeros(len(texts), "u8") if groups is None else spread(groups.astype("i8").view("u8"))
    parts = edits + 1
    found: list[tuple] = []

    def add(which: np.ndarray, at: np.ndarray, length: np.ndarray, role: np.ndarray, seed: np.ndarray) -> None:
        start = first[which] + at
        body = (sums[start + length] - sums[start]) * back[start]
        key = spread(body ^ spread(seeds[which] + seed.astype("u8") * np.uint64(_BASE)))
        found.append((which, key.view("i8"), role, at, at + length))

    index, probe = (roles & 1) != 0, (roles & 2) != 0
    for d in range(parts):
        n = size - d
        live = (n >= 0) & (probe if d else index | probe)
        tiny = np.flatnonzero(live & (n <= edits))
        # one row under the key of tiny strings, whichever d is the first to reach them
        tiny = tiny[(d == 0) | (n[tiny] + 1 > edits)]
        add(tiny, np.zeros(len(tiny), np.int64), np.zeros(len(tiny), np.int64), np.where(d == 0, roles[tiny], 2), np.zeros(len(tiny), np.int64))
        for i in range(parts):
            base, more = n // parts, n % parts
            p = i * base + np.maximum(0, i - (parts - more))
            k = base + (i >= parts - more)
            for shift in range(-edits, d + edits + 1):
                at = p + shift
                in_window = (at >= np.maximum(p - i, p + d - (edits - i))) & (at <= np.minimum(p + i, p + d + edits - i)) & (at >= 0) & (at + k <= size)
                own = (d == 0) & (shift == 0)
                which = np.flatnonzero(live & (n > edits) & ((in_window & probe) | (own & index)))
                if len(which):
                    role = np.where(own & index[which], np.where(in_window[which], roles[which], 1), 2)
                    add(which, at[which], k[which], role, n[which] * 31 + i + 1)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def portions(lines: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The lines in lists of about `most` characters, longer lines by themselves."""
    held, total = [], 0
    for x in lines:
        if held and total + len(x) > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += len(x)
    if held:
        yield held


def line_id(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether each pair has an edit distance of `edits` at most; lengths may differ by that.

    The band of 2 * edits + 1 diagonals of a pair's table is one machine word
    whose bits are the differences between neighbouring cells; a step brings all
    pairs one column further.
    """
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ok = np.abs(la - lb) <= edits
    out = np.zeros(len(a), bool)
    order = np.flatnonzero(ok)
    order = order[np.argsort(np.maximum(la, lb)[order], kind="stable")]
    k = len(order)
    while k:  # from the longest, in tables of four million characters or one pair
        few = min(k, 4096, max(1, (4 << 20) // max(1, int(max(la[order[k - 1]], lb[order[k - 1]])))))
        part = order[k - few : k]
        out[part] = _band([a[i] for i in part], [b[i] for i in part], la[part], lb[part], edits) <= edits
        k -= few
    return out


def _codes(texts: list[str], size: np.ndarray, width: int, left: int, fill: int) -> np.ndarray:
    """Code points of texts in columns (position, text), `left` positions of fill before them."""
    out = np.full((len(texts), left + width), fill, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(texts)), size), left + at] = flat
    return np.ascontiguousarray(out.T)


def _band(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    k, top = edits, 2 * edits
    one = np.uint64(1)
    mask = np.uint64((1 << (top + 1)) - 1)
    steps = int(lb.max(initial=0))
    # row i of column j is bit i - j + k, so the band's rows of column j are j - k ... j + k
    pa = _codes(a, la, steps + top + 2, k, -1)
    pb = _codes(b, lb, steps + 1, 0, -2)
    vp = np.full(len(a), ((1 << (k + 1)) - 1) << k, np.uint64)
    vn = np.zeros(len(a), np.uint64)
    dist = np.where(la < k, la, k)
    for j in range(1, steps + 1):
        x = np.zeros(len(a), np.uint64)
        for bit in range(top + 1):
            x |= (pa[j - 1 + bit] == pb[j - 1]).astype(np.uint64) << np.uint64(bit)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        on = j <= lb
        slant = j + k <= la
        place = np.clip(la - j + k, 0, top).astype(np.uint64)
        along = ((hp >> place) & one).astype(np.int64) - ((hn >> place) & one).astype(np.int64)
        dist = dist + np.where(on, np.where(slant, ((d0 >> np.uint64(top)) & one) == 0, along), 0)
        down = d0 >> one
        vp = (hn | ~(down | hp)) & mask
        vn = down & hp
    return dist


def _meet(rows: DataFrame, crowd: int) -> DataFrame:
    """Rows (key, h, role) to pairs (a, b) of groups of up to `crowd` rows, and (a, null, key, role) for the rows of larger ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def large(part: pd.DataFrame) -> pd.DataFrame:
            part = part.drop_duplicates()
            return pd.DataFrame({"a": part["h"], "b": pd.array([None] * len(part), "Int64"), "key": part["key"].astype("Int64"), "role": part["role"].astype("Int32")})

        for part, over in sorted_groups(batches, crowd):
            if over:
                yield large(part)
                continue
            key, h, role = part["key"].to_numpy(), part["h"].to_numpy(), part["role"].to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            left, right = [], []
            for g in np.flatnonzero(np.diff(cut) > 1):
                own, r = h[cut[g] : cut[g + 1]], role[cut[g] : cut[g + 1]]
                if (own == own[0]).all():
                    continue
                if len(own) > crowd:
                    rows_ = part.iloc[cut[g] : cut[g + 1]].drop_duplicates()
                    if len(rows_) > crowd:
                        yield large(rows_)
                        continue
                    own, r = rows_["h"].to_numpy(), rows_["role"].to_numpy()
                i, j = np.nonzero(((r & 1) != 0)[:, None] & ((r & 2) != 0)[None, :] & (own[:, None] != own[None, :]))
                left.append(np.minimum(own[i], own[j]))
                right.append(np.maximum(own[i], own[j]))
            if left:
                x = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()
                none = pd.array([None] * len(x), "Int64")
                yield pd.DataFrame({"a": x["a"], "b": x["b"].astype("Int64"), "key": none, "role": none.astype("Int32")})

    return dealt(rows).mapInPandas(run, "a long, b long, key long, role int")


def spanning(ids: np.ndarray, texts: list[str], edits: int) -> list[tuple[int, int]]:
    """Links between texts within `edits`, enough to join all that such links join."""
    n = len(ids)
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    size = np.array([len(t) for t in texts])
    counts = np.zeros((n, 32), np.int16)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    np.add.at(counts, (np.repeat(np.arange(n), size), flat & 31), 1)
    out, roots = [], np.arange(n)
    left: list[int] = []
    right: list[int] = []
    for k in range(n):
        near = np.flatnonzero((roots != roots[k]) & (np.abs(size - size[k]) <= edits))
        near = near[near > k]
        near = near[np.abs(counts[near] - counts[k]).sum(1) <= 2 * edits].tolist()
        left += [k] * len(near)
        right += near
        if len(left) >= 4096 or left and k == n - 1:
            for x, y, ok in zip(left, right, within([texts[x] for x in left], [texts[y] for y in right], edits).tolist(), strict=True):
                if ok and find(x) != find(y):
                    out.append((int(ids[x]), int(ids[y])))
                    up[find(y)] = find(x)
            left, right = [], []
            roots = np.array([find(x) for x in range(n)])
    return out


def _compare(rows: DataFrame, edits: int, room: int) -> DataFrame:
    """Rows (key, h, line) to links (a, b) within groups of up to `room` rows, and (a, null, key, line) for larger ones.

    Whole lines are compared: a forest of what the lines leave beside their
    segments could hold a false link in place of a true one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, over in sorted_groups(batches, room):
            if over:
                yield pd.DataFrame({"a": part["h"], "b": pd.array([None] * len(part), "Int64"), "key": part["key"].astype("Int64"), "line": part["line"]})
                continue
            found = []
            for _, own in part.groupby("key", sort=False):
                own = own.drop_duplicates("h")
                if len(own) > 1:
                    found += spanning(own["h"].to_numpy(), own["line"].tolist(), edits)
            if found:
                x = pd.DataFrame(found, columns=["a", "b"])
                none = pd.array([None] * len(x), "Int64")
                yield pd.DataFrame({"a": x.min(axis=1), "b": x.max(axis=1).astype("Int64"), "key": none, "line": pd.array([None] * len(x), "string")})

    return dealt(rows).mapInPandas(run, "a long, b long, key long, line string")


def _blocks(big: DataFrame, room: int) -> DataFrame:
    """Rows of groups over `room` once for each two blocks of room / 4 rows or so that the group is cut into."""
    per = big.groupBy("key").agg((F.floor(F.count("*") / (room // 4)) + 1).cast("int").alias("blocks"))
    own = big.join(written(per, "line-blocks").hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("a", F.lit(3)), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("a").alias("h"), "line")


def lines_of(docs: DataFrame, least: int, id_col: str, text_col: str, short: bool = False, row_col: str | None = None) -> DataFrame:
    """doc_id, line_no and line of every line of at least `least` characters, with row_col also `row`; with `short`, of shorter ones with a word in them too."""
    row = [F.col(row_col).alias("row")] if row_col else []
    split = docs.select(F.col(id_col).alias("doc_id"), *row, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))
    long = F.length("line") >= least
    return split.where(long | F.rlike("line", F.lit(WORD)) if short else long)


def candidate_pairs(docs: DataFrame, edits: int, least: int, crowd: int, room: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of line numbers (XXH64 of the line) that may be within `edits`, and the lines (h, line) in them."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for some in portions({x for t in pdf["text"] if isinstance(t, str) for x in t.split("\n") if len(x) >= least}):
                number = np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in some), "u8", len(some)).view("i8")
                which, key, role, _, _ = keyed(some, np.full(len(some), 3), edits)
                yield pd.DataFrame({"key": key, "h": number[which], "role": role.astype("i4")})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (key, h, role, line) of large groups to the keys, within the group, of what the line leaves beside the key's segment, which is rest; the line goes along."""
        for pdf in batches:
            at_row = 0
            for lines in portions(pdf["line"]):
                part = pdf.iloc[at_row : at_row + len(lines)]
                at_row += len(lines)
                key, role = part["key"].to_numpy(), part["role"].to_numpy()
                which, found, kind, at, end = keyed(lines, np.full(len(lines), 3), edits)
                own = np.flatnonzero((found == key[which]) & (kind == role[which]))
                which = which[own]
                rests = [lines[w][:a] + lines[w][e:] for w, a, e in zip(which.tolist(), at[own].tolist(), end[own].tolist(), strict=True)]
                row, found, _, _, _ = keyed(rests, role[which], edits, key[which])
                which = which[row]
                yield pd.DataFrame({"key": found, "h": part["h"].to_numpy()[which], "line": part["line"].to_numpy()[which]})

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    met = written(_meet(text.mapInPandas(first, "key long, h long, role int"), crowd), "line-keys")
    scratch = [met]
    near = met.where("b is not null").select("a", "b").distinct()
    big = met.where("b is null").select("key", F.col("a").alias("h"), "role").distinct()
    # all lines that the following steps need, so that texts are moved once
    need = near.select(F.explode(F.array("a", "b")).alias("h")).unionByName(big.select("h")).distinct()
    lines = text.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= least).withColumn("h", _short("line"))
    # repeats go before lines are dealt, so that a line of a third of all rows is a row a task; of two lines of one number both stay
    once = lines.groupBy("h").agg(F.min("line").alias("x"), F.max("line").alias("y")).join(need.hint("merge"), "h", "left_semi")
    texts = written(once.select("h", F.explode(F.array_distinct(F.array("x", "y"))).alias("line")), "line-texts")
    found = [near]
    if not big.isEmpty():
        rows = big.join(texts.hint("merge"), "h").select("key", "h", "role", "line").mapInPandas(again, "key long, h long, line string")
        met = written(_compare(rows, edits, room), "line-rests")
        scratch.append(met)
        while not (left := met.where("b is null")).isEmpty():
            found.append(met.where("b is not null").select("a", "b"))
            met = written(_compare(_blocks(left.select("key", "a", "line").distinct(), room), edits, room), "line-rests")
            scratch.append(met)
        found.append(met.where("b is not null").select("a", "b"))
    pairs = written(union_all(found).distinct(), "line-pairs")
    dropped(*scratch)
    return pairs, texts


def _short(line):
    """A line's number, XXH64 with seed 42 of its UTF-8."""
    return F.xxhash64(line)


def links(docs: DataFrame, edits: int, least: int, crowd: int, room: int, text_col: str) -> DataFrame:
    """Confirmed links (a, b) between different lines, by their MD5."""
    pairs, texts = candidate_pairs(docs, edits, least, crowd, room, text_col)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = pdf["x"].tolist(), pdf["y"].tolist()
            ok = within(x, y, edits)
            yield pd.DataFrame({"a": [line_id(s) for s, o in zip(x, ok, strict=True) if o], "b": [line_id(s) for s, o in zip(y, ok, strict=True) if o]})

    one = texts.select(F.col("h").alias("a"), F.col("line").alias("x")).hint("merge")
    two = texts.select(F.col("h").alias("b"), F.col("line").alias("y")).hint("merge")
    sizes = F.abs(F.length("x") - F.length("y")) <= edits
    joined = pairs.join(one, "a").join(two, "b").where(sizes).select("x", "y")
    out = written(joined.mapInPandas(check, "a binary, b binary"), "line-links")
    dropped(pairs, texts)
    return out


def occurrences(docs: DataFrame, edits: int = 2, least: int = 16, crowd: int = 64, room: int = 4096, id_col: str = "doc_id", text_col: str = "text", short: bool = False, row_col: str | None = None) -> DataFrame:
    """doc_id (and `row`, the value of row_col), line_no, class (MD5 of the class's least line), first (whether it stays), exact (whether an equal line stands before it), short (whether it has under `least` characters)."""
    linked = links(docs, edits, least, crowd, room, text_col)
    row = ["row"] if row_col else []
    own = lines_of(docs, least, id_col, text_col, short, row_col).select("doc_id", *row, "line_no", F.unhex(F.md5("line")).alias("id"), (F.length("line") < least).alias("short"))
    if linked.isEmpty():
        named = own.withColumn("class", F.col("id"))
    else:
        comp = components(linked).select(F.col("node").alias("id"), "component")
        named = own.join(comp.hint("merge"), "id", "left").select("doc_id", *row, "line_no", "id", "short", F.coalesce("component", "id").alias("class"))
    named = written(named.withColumn("uid", F.monotonically_increasing_id()), "line-occurrences")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no"), F.col("uid").alias("uid"))
    # most classes have one line only: those need no join
    many = written(named.groupBy("class").agg(F.min(order).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-first")
    same = written(named.groupBy("id").agg(F.min(order).alias("same"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-same")
    joined = named.join(many.hint("merge"), "class", "left").join(same.hint("merge"), "id", "left")
    return joined.select("doc_id", *row, "line_no", "class", F.coalesce(F.col("uid") == F.col("top.uid"), F.lit(True)).alias("first"), F.coalesce(F.col("uid") != F.col("same.uid"), F.lit(False)).alias("exact"), "short")


def dedup_report(docs: DataFrame, edits: int = 2, least: int = 16, crowd: int = 64, room: int = 4096, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """One row per document id: id, n_lines, n_long (lines judged), n_dropped, n_exact, n_near (of those dropped).

    Lines are the pieces between line feeds, compared as they are; those of
    fewer than `least` characters are not judged; with `short`, those with a
    word in them are, by equality alone, and n_short counts them. Lines within `edits` edits are
    linked, links make classes, and of a class the first line by (id, line
    number) stays in the whole corpus. n_exact: dropped lines equal to one
    before, n_near: other dropped ones. Null texts have no lines; an empty text
    has one, not judged. Null ids come last; rows that repeat an id are counted
    together; of lines that tie in (id, line number) one stays. Whole texts and
    lines of any length are read; other columns may have any names. An empty
    table gives an empty result.
    """
    marks = occurrences(docs, edits, least, crowd, room, id_col, text_col, short)
    per = marks.groupBy("doc_id").agg(F.count_if(~F.col("short")).alias("n_long"), F.count_if("short").alias("n_short"), F.count_if(~F.col("first")).alias("n_dropped"), F.count_if(~F.col("first") & F.col("exact")).alias("n_exact"))
    per = written(per, "line-report").withColumnRenamed("doc_id", "d")
    every = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.sum(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n")))).cast("long").alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.join(per, every["doc_id"].eqNullSafe(per["d"]), "left").select(
        F.col("doc_id").alias(id_col), "n_lines", zero("n_long").alias("n_long"), *([zero("n_short").alias("n_short")] if short else []), zero("n_dropped").alias("n_dropped"), zero("n_exact").alias("n_exact"), (zero("n_dropped") - zero("n_exact")).alias("n_near"),
    )


def drop_lines(docs: DataFrame, edits: int = 2, least: int = 16, crowd: int = 64, room: int = 4096, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """`docs` without the lines that the report counts as dropped; documents keep their rows.

    Rows are known by a number of their own, so null and repeated ids lose their
    lines like others: of rows that repeat id and text one keeps them. Null texts
    stay null; a document whose lines all go has an empty text. Other columns,
    whatever their names, stay as they are. The numbers of a document's dropped
    lines meet in one row, which is smaller than its text. An empty table stays
    empty.
    """
    row = "__lodestone_row"
    base = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-documents")
    gone = occurrences(base, edits, least, crowd, room, id_col, text_col, short, row).where("not first").groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias("__gone_lines"))
    joined = base.join(written(gone, "line-gone"), row, "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("__gone_lines", i))
    text = F.when(F.col("__gone_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
