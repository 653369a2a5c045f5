"""Top-k rankers over (user_id, item_id) rows. Scores are long frames (user_id, item_id, score); a pair without a row scores 0.

Matrix products are joins on the shared dimension with a sum, so they are dealt
by item or user; only the closed-form inverses and the item factors run in one
task, which their item limits guard.
"""

from __future__ import annotations

import hmac
import json
import secrets
import socket
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import ALPHA_MIN, ALPHA_N0, ALPHA_TAU, BPR, RANGE_EPSILON, RIDGE_GRID, SEED, VOCABULARY

#: Scores are rounded so that the order of summation cannot part equal ones.
DIGITS = 12


def interactions(df: DataFrame) -> DataFrame:
    """The binary matrix: distinct pairs."""
    return df.select("user_id", "item_id").distinct()


def unseen(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    return scores.join(pairs, ["user_id", "item_id"], "left_anti")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best items of each user with their rank; equal scores in order of the item."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "item_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def random_scores(users: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """A uniform number for each pair from a hash of pair and seed: the same however the data are dealt."""
    digest = F.md5(F.concat_ws("|", "user_id", "item_id", F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return users.crossJoin(items).select("user_id", "item_id", u.alias("score"))


def popularity(pairs: DataFrame) -> DataFrame:
    """item_id, score: number of distinct users."""
    return pairs.groupBy("item_id").agg(F.count("*").cast("double").alias("score"))


def mostpop_top(pairs: DataFrame, k: int) -> DataFrame:
    """Each user's k most popular unseen items.

    These are among the first k + (items seen) of all, so a user meets no more
    items than that.
    """
    ranked = popularity(pairs).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))
    need = pairs.groupBy("user_id").agg((F.count("*") + k).alias("need"))
    return top_k(unseen(need.join(ranked, F.col("place") <= F.col("need")).select("user_id", "item_id", "score"), pairs), k)


def item_similarity(pairs: DataFrame) -> DataFrame:
    """a, b, sim: cosine of the items' user sets, a <> b."""
    n = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    x = pairs.join(n, "item_id")
    a, b = x.select("user_id", F.col("item_id").alias("a"), F.col("n").alias("na")), x.select("user_id", F.col("item_id").alias("b"), F.col("n").alias("nb"))
    both = a.join(b, "user_id").where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return both.select("a", "b", (F.col("c") / F.sqrt(F.col("na") * F.col("nb"))).alias("sim"))


def neighbours(sim: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a; equal similarities, rounded, in order of b."""
    return sim.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", DIGITS)), "b"))).where(F.col("_n") <= k).drop("_n")


def itemknn(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Sum over the user's items of their similarity to the scored one; with k over that item's k nearest only."""
    sim = item_similarity(pairs)
    if k is not None:
        sim = neighbours(sim, k).select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    s = pairs.join(sim, pairs["item_id"] == sim["a"]).groupBy("user_id", F.col("b").alias("item_id")).agg(F.sum("sim").alias("score"))
    return s.withColumn("score", F.round("score", DIGITS))


def userknn(pairs: DataFrame) -> DataFrame:
    """Sum of the cosines of all users with the item, for unseen items.

    (1 / sqrt n_u) * sum over the user's items i of G[i, j], where G[i, j] sums
    1 / sqrt n_v over the users v of both: no pair of users is made, only pairs
    of items within a user.
    """
    n = pairs.groupBy("user_id").agg(F.count("*").alias("n"))
    x = pairs.join(n, "user_id").select("user_id", "item_id", F.sqrt(F.col("n").cast("double")).alias("r"))
    g = x.select("user_id", "r", F.col("item_id").alias("a")).join(pairs.select("user_id", F.col("item_id").alias("b")), "user_id").groupBy("a", "b").agg(F.sum(1 / F.col("r")).alias("g"))
    s = x.join(g, x["item_id"] == g["a"]).groupBy("user_id", "r", F.col("b").alias("item_id")).agg(F.sum("g").alias("s"))
    return unseen(s.select("user_id", "item_id", F.round(F.col("s") / F.col("r"), DIGITS).alias("score")), pairs)


def userknn_neighbours(pairs: DataFrame, k: int, block: int = 2_048, part_pairs: int = 5_000_000) -> DataFrame:
    """The same over each user's k nearest users only; equal cosines, rounded, in order of the user. pairs: distinct.

    Blocks of users meet all users, part by part, in matrix products; a task
    keeps its block's k nearest, so pairs of users are neither dealt nor
    written. Neighbours' items are summed in the same way. A part has about
    part_pairs pairs (and one user at least). Null users and items have no
    neighbours by them; a neighbour's null item has a score.
    """
    user, item = (pairs.schema[c].dataType.simpleString() for c in ("user_id", "item_id"))
    sets = _cut(pairs.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n"), F.collect_list("item_id").alias("items")))
    size = sets.agg(F.count("*").alias("users"), F.sum("n").alias("pairs")).first()
    blocks, parts = max(1, -(-size["users"] // block)), max(1, -(-(size["pairs"] or 0) // part_pairs))

    def packed(count: int, name: str) -> DataFrame:
        rows = sets.groupBy(F.pmod(F.xxhash64("user_id", F.lit(count)), F.lit(count)).cast("int").alias(name)).agg(F.collect_list(F.struct("user_id", "n", "items")).alias("rows"))
        part = lambda c: F.transform("rows", lambda r: r[c])
        cols = (("users", part("user_id")), ("n", part("n")), ("sizes", F.transform("rows", lambda r: F.size(r["items"]))), ("items", F.flatten(part("items"))))
        return _cut(rows.select(name, *[c.alias(f"{name}_{k}") for k, c in cols]).repartitionById(count, name))

    left, right = packed(blocks, "a"), packed(parts, "b").hint("shuffle_replicate_nl")
    schema = f"a int, users array<{user}>, counts array<long>, near array<{user}>, sims array<double>"

    def meet(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                own, other = _Sets(r.a_users, r.a_n, r.a_sizes, r.a_items), _Sets(r.b_users, r.b_n, r.b_sizes, r.b_items)
                yield _near_frame(r.a, own.users, _nearest(own, other, k))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.concatenate([np.repeat(np.arange(len(c)), c) for c in pdf["counts"]])
        found = row, np.concatenate([_plain(x) for x in pdf["near"]]), np.concatenate(list(pdf["sims"]))
        return _near_frame(pdf["a"].iloc[0], _plain(pdf["users"].iloc[0]), _k_best(found, k))

    def score(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                row = np.repeat(np.arange(len(r.users)), r.counts)
                for at, items, total in _neighbour_sums(row, _plain(r.near), np.asarray(r.sims), _Sets(r.b_users, r.b_n, r.b_sizes, r.b_items)):
                    yield pd.DataFrame({"user_id": _plain(r.users)[at], "item_id": items, "score": total})

    near = left.crossJoin(right).mapInPandas(meet, schema)
    if parts > 1:
        near = _cut(near.groupBy("a").applyInPandas(merge, schema))
    s = near.crossJoin(right).mapInPandas(score, f"user_id {user}, item_id {item}, score double")
    return unseen(s.groupBy("user_id", "item_id").agg(F.round(F.sum("score"), DIGITS).alias("score")), pairs)


def _plain(x) -> np.ndarray:
    """An array of numbers or strings, of a type that numpy can sort."""
    x = np.asarray(x)
    return np.array(x.tolist()) if x.dtype == object else x


class _Sets:
    """Users with the number of their pairs and their items, one after the other; null items are counted only."""

    def __init__(self, users, n, sizes, items):
        self.users, self.n, self.sizes, self.items = _plain(users), np.asarray(n, float), np.asarray(sizes, np.int64), _plain(items)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def cut(self, lo: int, hi: int) -> _Sets:
        at = slice(int(self.sizes[:lo].sum()), int(self.sizes[:hi].sum()))
        return _Sets(self.users[lo:hi], self.n[lo:hi], self.sizes[lo:hi], self.items[at])


def _near_frame(a: int, users: np.ndarray, best: tuple) -> pd.DataFrame:
    row, near, sims = best
    return pd.DataFrame({"a": [a], "users": [users], "counts": [np.bincount(row, minlength=len(users))], "near": [near], "sims": [sims]})


def _k_best(found: tuple, k: int) -> tuple:
    """The first k of each row by cosine, rounded, and user; found: rows, users, cosines."""
    row, who, sim = found
    order = np.lexsort((who, -np.round(sim, DIGITS), row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    order = order[place < k]
    return found[0][order], who[order], sim[order]


def _nearest(own: _Sets, other: _Sets, k: int, width: int = 4_096, step: int = 1_024) -> tuple:
    """Rows of `own`, users of `other` and their cosines, at most k a row.

    Counts of common items are whole numbers in float32. They are held against
    the k-th best so far with a margin; what passes has its cosine worked out in full.
    """
    found, held, best = [], 0, None
    floor = np.full(len(own.users), 1e-12)
    root = np.sqrt(own.n)
    for lo in range(0, len(other.users), width):
        part = other.cut(lo, lo + width)
        common = np.intersect1d(own.items, part.items)
        count = np.zeros((len(own.users), len(part.users)), np.float32)
        for c in range(0, len(common), step):
            some = common[c : c + step]
            one, two = np.zeros((len(own.users), len(some)), np.float32), np.zeros((len(part.users), len(some)), np.float32)
            for matrix, x in ((one, own), (two, part)):
                place = np.minimum(np.searchsorted(some, x.items), len(some) - 1)
                mine = some[place] == x.items
                matrix[x.row[mine], place[mine]] = 1
            count += one @ two.T
        _, i, j = np.intersect1d(own.users, part.users, return_indices=True)
        count[i, j] = 0
        near = count * (1 / np.sqrt(part.n)).astype(np.float32)
        low = np.maximum(floor * root * (1 - 1e-5), 1e-12)
        hit = near >= low.astype(np.float32)[:, None]
        if near.shape[1] > k and np.count_nonzero(hit) > 2 * k * len(near):  # at first most would pass: this part's own k-th best bounds them
            low = np.maximum(low, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] * (1 - 1e-5))
            hit = near >= low.astype(np.float32)[:, None]
        i, j = np.nonzero(hit)
        found.append((i, part.users[j], count[i, j].astype(float) / np.sqrt(own.n[i] * part.n[j])))
        held += len(i)
        if best is None or held > 2 * k * len(near) or lo + width >= len(other.users):
            best = _k_best(tuple(np.concatenate(x) for x in zip(*found, strict=True)), k)
            found, held = [best], 0
            last = np.searchsorted(best[0], np.arange(len(near)), "right") - 1
            full = np.bincount(best[0], minlength=len(near)) == k
            floor[full] = best[2][last[full]]
    return best


def _neighbour_sums(row: np.ndarray, near: np.ndarray, sims: np.ndarray, sets: _Sets, most: int = 1_000_000):
    """Sums of cosines by row and item over those of `near` that are in `sets`: frames of rows, items, sums, to be summed again."""
    by = np.argsort(sets.users, kind="stable")
    place = np.minimum(np.searchsorted(sets.users[by], near), len(by) - 1)
    mine = sets.users[by][place] == near
    row, who, sims = row[mine], by[place[mine]], sims[mine]
    bare = sets.n[who] > sets.sizes[who]  # with a null item
    if bare.any():
        hit, total = _summed(row[bare], sims[bare])
        yield hit, [None] * len(hit), total
    items, item = np.unique(sets.items, return_inverse=True)
    # rows in order, some at a time, so that their sums and their neighbours' items are few enough
    ends = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else []
    work = np.cumsum(np.r_[0, sets.sizes[who]])[ends] if len(row) else []
    lo = 0
    while lo < len(ends) - 1:
        hi = int(np.searchsorted(work, work[lo] + most, "right")) - 1
        hi = max(lo + 1, min(hi, lo + max(1, 8 * most // max(1, len(items)))))
        at = slice(ends[lo], ends[hi])
        n = sets.sizes[who[at]]
        cell = np.repeat(sets.first[who[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total = np.bincount(np.repeat(row[at] - lo, n) * len(items) + item[cell], weights=np.repeat(sims[at], n), minlength=1)
        hit = np.flatnonzero(total)
        if len(hit):
            yield lo + hit // len(items), items[hit % len(items)], total[hit]
        lo = hi


def tfidf(docs: DataFrame, item: str, text: str, vocabulary: int = VOCABULARY) -> DataFrame:
    """item, term, weight: tf * idf, tf a term's share of all of the item's tokens, idf = ln((1 + N) / (1 + df)) + 1, N all items."""
    tokens = docs.select(F.col(item).alias("item"), T.text_tokens(F.col(text)).alias("tokens"))
    n = docs.agg(F.count("*").alias("n_docs"))
    terms = tokens.select("item", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("item", "len", "term").agg(F.count("*").alias("c"))
    vocab = terms.groupBy("term").agg(F.sum("c").alias("f"), F.count("*").alias("df")).orderBy(F.desc("f"), "term").limit(vocabulary)
    idf = vocab.crossJoin(n).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # n has one row
    return terms.join(idf, "term").select("item", "term", (F.col("c") / F.col("len") * F.col("idf")).alias("weight"))


def unit(weights: DataFrame, key: str) -> DataFrame:
    """Weights divided by their key's length."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_l"))
    return weights.join(norms, key).withColumn("weight", F.col("weight") / F.nullif(F.col("_l"), F.lit(0.0))).drop("_l")


def content_scores(rows: DataFrame, item_weights: DataFrame) -> DataFrame:
    """Cosine of an item with the mean of the user's items, train rows counted as often as they occur; items without text have no score."""
    items = unit(item_weights.select(F.col("item").alias("item_id"), "term", "weight"), "item_id")
    times = rows.groupBy("user_id", "item_id").agg(F.count("*").alias("t"))
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    user = times.join(items, "item_id").groupBy("user_id", "term").agg(F.sum(F.col("t") * F.col("weight")).alias("weight")).join(n, "user_id")
    user = unit(user.select("user_id", "term", (F.col("weight") / F.col("n")).alias("weight")), "user_id")
    s = user.select("user_id", "term", F.col("weight").alias("w")).join(items, "term").groupBy("user_id", "item_id").agg(F.round(F.sum(F.col("w") * F.col("weight")), DIGITS).alias("score"))
    covered = items.select("item_id").distinct()
    return user.select("user_id").distinct().crossJoin(covered).join(s, ["user_id", "item_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def coverage(items: DataFrame, item: str, text: str) -> DataFrame:
    """n, covered, covered_pct: items with text."""
    return items.agg(F.count("*").alias("n"), F.count_if(~T.is_blank(F.col(text))).alias("covered")).withColumn("covered_pct", T.percent(F.col("covered"), F.col("n"), 2))


def dense(scores: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """A score for every user and item, 0 where there was none."""
    return users.crossJoin(items).join(scores, ["user_id", "item_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def minmax(scores: DataFrame, score: str = "score") -> DataFrame:
    """Each user's scores to [0, 1]; 0 where their range is below 1e-8. Seen items take part."""
    ends = scores.groupBy("user_id").agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return scores.join(ends, "user_id").withColumn(score, F.when(span < RANGE_EPSILON, F.lit(0.0)).otherwise((F.col(score) - F.col("_lo")) / span)).drop("_lo", "_hi")


def fused(cf: Column, content: Column, weight: Column) -> Column:
    """weight * cf + (1 - weight) * content; where one is missing the other stands in."""
    return weight * F.coalesce(cf, content) + (1 - weight) * F.coalesce(content, cf)


def adaptive_weight(n: Column, n0: Column | float = ALPHA_N0, tau: Column | float = ALPHA_TAU, alpha_min: Column | float = ALPHA_MIN) -> Column:
    """The collaborative share after n rows: from alpha_min to 1 by a logistic curve around n0."""
    low = alpha_min if isinstance(alpha_min, Column) else F.lit(float(alpha_min))
    return low + (1 - low) / (1 + F.exp(-(n - n0) / tau))


def hybrid(cf: DataFrame, content: DataFrame, rows: DataFrame, lam: float | None = None, **curve) -> DataFrame:
    """Fixed (lam) or adaptive fusion of two normalised dense score frames; the adaptive weight depends on the user's train rows."""
    both = cf.withColumnRenamed("score", "cf").join(content.withColumnRenamed("score", "cb"), ["user_id", "item_id"], "full")
    if lam is not None:
        return both.select("user_id", "item_id", fused(F.col("cf"), F.col("cb"), F.lit(float(lam))).alias("score"))
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    both = both.join(n, "user_id", "left").withColumn("w", adaptive_weight(F.coalesce("n", F.lit(0)), **curve))
    return both.select("user_id", "item_id", fused(F.col("cf"), F.col("cb"), F.col("w")).alias("score"))


def gram(pairs: DataFrame) -> DataFrame:
    """a, b, c: users of both items."""
    return pairs.select("user_id", F.col("item_id").alias("a")).join(pairs.select("user_id", F.col("item_id").alias("b")), "user_id").groupBy("a", "b").agg(F.count("*").alias("c"))


def _closed_form(pdf: pd.DataFrame, lam: float, normalise: str) -> pd.DataFrame:
    """a, b, weight from the gram's rows (a, b, c)."""
    ids = np.unique(pdf["a"])
    g = np.zeros((len(ids), len(ids)))
    g[np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])] = pdf["c"]
    p = np.linalg.inv(g + lam * np.eye(len(ids)))
    d = np.diag(p)
    w = -p / (d[:, None] if normalise == "row" else d[None, :])
    np.fill_diagonal(w, 0.0)
    i, j = np.nonzero(w)
    return pd.DataFrame({"a": ids[i], "b": ids[j], "weight": w[i, j]})


def ridge_weights(pairs: DataFrame, lam: float, normalise: str = "row", max_items: int = 8_000) -> DataFrame:
    """a, b, weight of the closed-form item regression, diagonal 0.

    P = inverse of (gram + lam * I). normalise: 'row' divides by the diagonal of
    P by rows, 'column' by columns, the published form. One task holds the gram
    of at most max_items items, which with its rows and its inverse takes about
    3 GB at 8,000; more raise ValueError.
    """
    if normalise not in ("row", "column"):
        raise ValueError(normalise)
    if (n := pairs.select("item_id").distinct().count()) > max_items:
        raise ValueError(f"{n} items are more than {max_items}")
    kind = pairs.schema["item_id"].dataType.simpleString()
    return gram(pairs).groupBy().applyInPandas(lambda pdf: _closed_form(pdf, lam, normalise), f"a {kind}, b {kind}, weight double")


def ridge_grid(pairs: DataFrame, lams: tuple[float, ...] = RIDGE_GRID, normalise: str = "row", max_items: int = 8_000) -> DataFrame:
    """lam, user_id, item_id, score: the closed form for a grid of penalties, one task for each, from one gram."""
    if (n := pairs.select("item_id").distinct().count()) > max_items:
        raise ValueError(f"{n} items are more than {max_items}")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _closed_form(pdf, float(key[0]), normalise).assign(lam=float(key[0]))

    kind = pairs.schema["item_id"].dataType.simpleString()
    g = gram(pairs).withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lams])))
    w = g.groupBy("lam").applyInPandas(run, f"a {kind}, b {kind}, weight double, lam double")
    s = pairs.join(w, pairs["item_id"] == w["a"]).groupBy("lam", "user_id", F.col("b").alias("item_id"))
    return s.agg(F.round(F.sum("weight"), DIGITS).alias("score"))


def mf(rows: DataFrame, rating: str = "rating", rank: int = 32, reg: float = 0.1, iterations: int = 10, seed: int = SEED):
    """Matrix factorisation of ratings by the distributed alternating least squares; with its squared penalties also the probabilistic form."""
    from pyspark.ml.recommendation import ALS

    mean = rows.groupBy(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id")).agg(F.avg(rating).cast("float").alias("r"))
    return ALS(userCol="user_id", itemCol="item_id", ratingCol="r", rank=rank, regParam=reg, maxIter=iterations, seed=seed, coldStartStrategy="drop").fit(mean)


def weighted_scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    s = pairs.join(weights, pairs["item_id"] == weights["a"]).groupBy("user_id", F.col("b").alias("item_id")).agg(F.round(F.sum("weight"), DIGITS).alias("score"))
    return s


def ease(pairs: DataFrame, lam: float, normalise: str = "row") -> DataFrame:
    return weighted_scores(pairs, ridge_weights(pairs, lam, normalise))


def sansa(pairs: DataFrame, lam: float) -> DataFrame:
    """The column-normalised form, which on unseen items equals the factorised one."""
    return ease(pairs, lam, "column")


def bpr(rows: DataFrame, seed: int = SEED, factors: int = BPR["factors"], lr: float = BPR["lr"], reg: float = BPR["reg"], epochs: int = BPR["epochs"], batch: int = 256, rounds: int = 4, block_rows: int = 200_000) -> DataFrame:
    """Factors (kind 'user' or 'item', id, factors) that rank each user's items above others by a logistic loss on score differences.

    Distinct pairs are dealt into blocks of about block_rows, a user's pairs
    together but for users with more than a quarter of a block, which are cut.
    In each of `rounds` rounds a block trains its share of the epochs on copies
    of its factors (AdaGrad; negatives are drawn from the block's items that the
    user does not have), and copies are averaged, weighted by their pairs. So no
    task holds more than a block, and one block is plain training. Ids are longs.
    """
    pairs = interactions(rows)
    n = pairs.count()
    blocks = max(1, -(-n // block_rows))
    per = pairs.groupBy("user_id").agg((F.floor(F.count("*") / max(1, block_rows // 4)) + 1).alias("cuts"))
    cut = F.pmod(F.xxhash64("item_id", F.lit(seed)), F.col("cuts"))
    dealt = pairs.join(per, "user_id").select(F.pmod(F.xxhash64("user_id", cut, F.lit(seed + 1)), F.lit(blocks)).cast("int").alias("block"), "user_id", "item_id")
    member = dealt.select(F.col("block").alias("of"), F.inline(F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")), F.struct(F.lit("item").alias("kind"), F.col("item_id").alias("id"))))).distinct()
    schema = "kind string, id long, factors array<double>, pairs long"
    model = None
    for turn in range(rounds):
        local = epochs * (turn + 1) // rounds - epochs * turn // rounds
        start = member.withColumn("factors", F.lit(None).cast("array<double>")) if model is None else member.join(model, ["kind", "id"], "left")
        out = dealt.groupBy("block").cogroup(start.groupBy("of")).applyInPandas(_block_trainer(seed + 1000 * turn, local, factors, lr, reg, batch), schema)
        w = F.col("pairs").cast("double")
        model = out.groupBy("kind", "id").agg(F.array(*[F.sum(F.col("factors")[k] * w) / F.sum(w) for k in range(factors)]).alias("factors"))
        if turn + 1 < rounds:
            model = _cut(model)
    return model


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in spark.checkpoint.dir; where the session has none it is kept on disk instead, so that it is worked out once."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _block_trainer(*settings):
    """A function of (key, pairs, factors) for cogrouped blocks."""

    def run(key, own, start):
        return _train_block(own, start, int(key[0]), *settings)

    return run


def _train_block(own: pd.DataFrame, start: pd.DataFrame, block: int, seed: int, epochs: int, factors: int, lr: float, reg: float, batch: int) -> pd.DataFrame:
    """One block's factors after `epochs` passes over its pairs, from the given ones or, where null, from small numbers drawn by id."""
    table = start.sort_values(["kind", "id"], ascending=[False, True]).reset_index(drop=True)  # users, then items
    n_users = int((table["kind"] == "user").sum())
    ids = table["id"].to_numpy()
    theta = np.stack([np.random.default_rng([abs(int(i)), k < n_users, seed]).normal(0, 0.1, factors) if f is None else np.asarray(f, float) for k, (i, f) in enumerate(zip(ids, table["factors"], strict=True))])
    u = np.searchsorted(ids[:n_users], own["user_id"].to_numpy())
    i = n_users + np.searchsorted(ids[n_users:], own["item_id"].to_numpy())
    order = np.lexsort((i, u))
    u, i = u[order], i[order]
    taken = u.astype(np.int64) * len(ids) + i  # sorted
    rng = np.random.default_rng([block, seed])
    slope = np.full(len(ids), 1e-8)  # AdaGrad's sum of squares, one number a row
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(u)), -(-len(u) // batch)):
            who, liked = u[part], i[part]
            other = rng.integers(n_users, len(ids), len(part))
            again = np.isin(who.astype(np.int64) * len(ids) + other, taken)
            other[again] = rng.integers(n_users, len(ids), int(again.sum()))
            gap = theta[liked] - theta[other]
            pull = 1 / (1 + np.exp(np.clip((theta[who] * gap).sum(1), -30, 30)))
            # gradient of -log sigmoid + reg / 2 * squares, summed by row through one sparse product
            row = np.concatenate([who, liked, other])
            grad = np.concatenate([-pull[:, None] * gap, -pull[:, None] * theta[who], pull[:, None] * theta[who]]) + reg * theta[row]
            hit, place = np.unique(row, return_inverse=True)
            by = np.argsort(place, kind="stable")
            total = np.add.reduceat(grad[by], np.searchsorted(place[by], np.arange(len(hit))), axis=0)
            slope[hit] += (total * total).mean(1)
            theta[hit] -= lr * total / np.sqrt(slope[hit])[:, None]
    weight = np.bincount(np.concatenate([u, i]), minlength=len(ids))
    return pd.DataFrame({"kind": table["kind"], "id": ids, "factors": list(theta), "pairs": weight})


def factor_scores(model: DataFrame) -> DataFrame:
    """Dot products of all users' and items' factors."""
    u = model.where("kind = 'user'").select(F.col("id").alias("user_id"), F.col("factors").alias("p"))
    i = model.where("kind = 'item'").select(F.col("id").alias("item_id"), F.col("factors").alias("q"))
    dot = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return u.crossJoin(i).select("user_id", "item_id", F.round(dot, DIGITS).alias("score"))


def item_factors(pairs: DataFrame, dim: int = 32, max_items: int = 8_000) -> DataFrame:
    """item_id, factors: the leading eigenvectors of the gram times the singular values; signs fixed by each one's largest entry."""
    if pairs.select("item_id").distinct().count() > max_items:
        raise ValueError(f"more than {max_items} items")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["a"])
        g = np.zeros((len(ids), len(ids)))
        g[np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])] = pdf["c"]
        value, vec = np.linalg.eigh(g)
        value, vec = value[::-1][:dim], vec[:, ::-1][:, :dim]
        vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
        return pd.DataFrame({"item_id": ids, "factors": list(vec * np.sqrt(np.maximum(value, 0)))})

    kind = pairs.schema["item_id"].dataType.simpleString()
    return gram(pairs).groupBy().applyInPandas(run, f"item_id {kind}, factors array<double>")


def wmf(rows: DataFrame, rank: int = 32, reg: float = 0.01, alpha: float = 1.0, iterations: int = 10, seed: int = SEED):
    """Weighted matrix factorisation by the distributed alternating least squares."""
    from pyspark.ml.recommendation import ALS

    counts = rows.groupBy("user_id", "item_id").agg(F.count("*").cast("float").alias("n")).select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), "n")
    return ALS(userCol="user_id", itemCol="item_id", ratingCol="n", implicitPrefs=True, rank=rank, regParam=reg, alpha=alpha, maxIter=iterations, seed=seed).fit(counts)


def graph_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, weight: both directions of the user-item graph, weighted 1 / sqrt(degree * degree). Nodes are 'u' or 'i' and the id."""
    u, i = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("i"), F.col("item_id").cast("string"))
    e = pairs.select(u.alias("src"), i.alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    return both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def propagate(edges: DataFrame, state: DataFrame, layers: int = 3) -> DataFrame:
    """node, dim, value: the mean of the start (node, dim, value) and `layers` steps of weighted sums over neighbours."""
    total, now = state, state
    for _ in range(layers):
        now = edges.join(now, edges["src"] == now["node"]).groupBy(F.col("dst").alias("node"), "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
        total = total.unionByName(now)
    return total.groupBy("node", "dim").agg((F.sum("value") / (layers + 1)).alias("value"))


def lightgcn(pairs: DataFrame, dim: int = 32, layers: int = 3, lr: float = 0.05, reg: float = 1e-4, epochs: int = 50, batch: int = 2048, seed: int = SEED, max_pairs: int = 5_000_000, task_pairs: int = 50_000) -> DataFrame:
    """Graph-propagated factors (kind, id, factors) trained by pairwise ranking, Adam, all layers' mean.

    Propagation is linear and symmetric, so the gradient of the start is the
    propagated gradient of the end. Users' layers are products with items', and
    items' second next layer is the items' gram times it: so a step costs two
    products with all pairs (`_Bipartite`), whatever the layers, and only the
    batch's users are propagated.

    Ranges of users are dealt to tasks that run at the same time (a barrier
    stage), one for task_pairs pairs and as many as the session has slots. Each
    holds its users' rows and all items', and what the items get from users is
    added up over sockets (`_Peers`) in the order of the tasks. So all take the
    steps that one task would; their number changes the last digits only. With
    dynamic allocation, which has no barrier stages, one task trains. More than
    max_pairs pairs a task raise ValueError. Ids are longs; a null user or item
    is a node as any other, the last one.
    """
    spark = pairs.sparkSession
    parts = [x for c in ("user", "item") for x in (F.coalesce(F.col(f"{c}_id").cast("long"), F.lit(0)).alias(c), F.col(f"{c}_id").isNull().alias(f"no_{c}"))]
    pairs = pairs.select(*parts).persist(StorageLevel.DISK_ONLY)
    n = pairs.count()
    tasks = max(1, min(_slots(spark), -(-n // task_pairs)))
    if n > max_pairs * tasks:
        pairs.unpersist()
        raise ValueError(f"{n} pairs are more than {max_pairs} for each of {tasks} tasks")

    def run(batches):
        empty = pd.DataFrame({c: np.zeros(0, t) for c, t in (("user", int), ("no_user", bool), ("item", int), ("no_item", bool))})
        yield from _train_graph(pd.concat([pdf for pdf in batches if len(pdf)] or [empty]), BarrierTaskContext.get() if tasks > 1 else None, dim, layers, lr, reg, epochs, batch, seed)

    model = (_by_range(pairs, tasks) if tasks > 1 else pairs.repartition(1)).mapInPandas(run, "kind string, id long, factors array<double>", barrier=tasks > 1)
    # dealt, as scores are worked out where users are; cut, as users and items are read apart and would be trained for each
    model = _cut(model.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "id"))
    if spark.conf.get("spark.checkpoint.dir", None):  # else the model is worked out when it is read
        pairs.unpersist()
    return model


def _by_range(pairs: DataFrame, parts: int) -> DataFrame:
    """Ranges of users with about as many pairs, in exactly `parts` partitions, whatever the session's settings; null users in the last."""
    known = pairs.where(~F.col("no_user"))
    ends = known.approxQuantile("user", [k / parts for k in range(1, parts)], 0.01 / parts)
    part = F.size(F.filter(F.array(*[F.lit(x) for x in ends]).cast("array<double>"), lambda end: F.col("user") > end))
    return pairs.withColumn("part", F.when(F.col("no_user"), parts - 1).otherwise(part)).repartitionById(parts, "part").drop("part")


def _slots(spark: SparkSession) -> int:
    """The tasks that can run at once: a barrier stage with more would not start. 1 where there are no barrier stages."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    jvm = context._jsc.sc()
    return max(1, jvm.maxNumConcurrentTasks(jvm.resourceProfileManager().defaultResourceProfile()))


class _Peers:
    """The tasks of a barrier stage, or one task alone (context None), which add up arrays.

    All meet once through Spark's own messages, which take a second, and then
    over sockets: the first task takes the others' parts, adds them in the
    order of the tasks and sends the sum back. A lost task closes its socket,
    which fails the others, and Spark repeats the stage.
    """

    def __init__(self, context: BarrierTaskContext | None, facts: dict, timeout: float = 600.0):
        """facts: what the others shall know of this task; `facts` of all in the tasks' order."""
        self.facts, self.others, self.first = [facts], [], None
        if context is None:
            return
        me, listener = context.partitionId(), None
        host = context.getTaskInfos()[0].address.rsplit(":", 1)[0].strip("[]")
        if me == 0:
            listener = socket.create_server(("", 0), family=socket.AF_INET6 if ":" in host else socket.AF_INET, backlog=1024)
            listener.settimeout(timeout)
            facts = {**facts, "port": listener.getsockname()[1], "token": secrets.token_hex(16)}
        self.facts = [json.loads(x) for x in context.allGather(json.dumps(facts))]
        token = bytes.fromhex(self.facts[0]["token"])
        if me:
            self.first = self._set(socket.create_connection((host, self.facts[0]["port"]), timeout), timeout)
            self.first.sendall(token + me.to_bytes(4, "big"))
            return
        found = {}
        while len(found) < len(self.facts) - 1:
            other = self._set(listener.accept()[0], timeout)
            hello = bytearray(len(token) + 4)
            try:
                self._fill(other, hello)
            except OSError:
                other.close()
                continue
            if hmac.compare_digest(bytes(hello[: len(token)]), token):
                found[int.from_bytes(hello[len(token) :], "big")] = other
            else:
                other.close()
        listener.close()
        self.others = [found[k] for k in sorted(found)]

    @staticmethod
    def _set(s: socket.socket, timeout: float) -> socket.socket:
        s.settimeout(timeout)
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return s

    @staticmethod
    def _fill(s: socket.socket, buffer) -> None:
        view = memoryview(buffer).cast("B")
        while len(view):
            got = s.recv_into(view)
            if not got:
                raise ConnectionError("a task of this stage has gone")
            view = view[got:]

    def add(self, x: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays, which have one shape and are of doubles."""
        total = np.array(x, dtype=float)
        if self.first is not None:
            self.first.sendall(memoryview(total).cast("B"))
            self._fill(self.first, total)
        elif self.others:
            part = np.empty_like(total)
            for s in self.others:
                self._fill(s, part)
                total += part
            for s in self.others:
                s.sendall(memoryview(total).cast("B"))
        return total

    def close(self) -> None:
        for s in [*self.others, *([] if self.first is None else [self.first])]:
            s.close()


def _normal(rng: np.random.Generator, rows: int, dim: int, keep: bool = True, block: int = 65_536) -> np.ndarray | None:
    """The next rows of the start; drawn in blocks if only passed over."""
    if keep:
        return rng.normal(0, 0.1, (rows, dim))
    for lo in range(0, rows, block):
        rng.normal(0, 0.1, (min(block, rows - lo), dim))
    return None


def _train_graph(pdf: pd.DataFrame, context: BarrierTaskContext | None, dim: int, layers: int, lr: float, reg: float, epochs: int, batch: int, seed: int) -> Iterator[pd.DataFrame]:
    """A task's share of `lightgcn`: the factors of its users and, from the first task, of all items. All tasks draw the same numbers."""
    user, no_user, item, no_item = (c.to_numpy() for _, c in pdf.sort_values(["no_user", "user", "no_item", "item"])[["user", "no_user", "item", "no_item"]].items())
    new = np.r_[True, (user[1:] != user[:-1]) | (no_user[1:] != no_user[:-1])][: len(user)]
    users, u = _ids(user[new], no_user[new]), np.cumsum(new) - 1
    me = context.partitionId() if context else 0
    peers = _Peers(context, {"users": len(users), "pairs": len(u), "items": np.unique(item[~no_item]).tolist(), "no_item": bool(no_item.any())})
    known, blank = np.unique(np.concatenate([np.array(f["items"], dtype=int) for f in peers.facts])), any(f["no_item"] for f in peers.facts)
    n_users, n_pairs, n_items = sum(f["users"] for f in peers.facts), sum(f["pairs"] for f in peers.facts), len(known) + blank
    before = {k: sum(f[k] for f in peers.facts[:me]) for k in ("users", "pairs")}
    if not n_pairs:
        return
    i = np.where(no_item, len(known), np.searchsorted(known, item))
    graph = _Bipartite(u, i, len(users), n_items, peers, 8 * n_pairs >= n_users * n_items)

    def spread(start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means over all layers of the items' layers but for the last, and of all of them. first: the layer after the start, which comes from the users."""
        now = [start, first]
        while len(now) <= layers:
            now.append(graph.gram(now[-2]))
        return sum(now[:layers], np.zeros_like(start)) / (layers + 1), sum(now[: layers + 1], np.zeros_like(start)) / (layers + 1)

    rng = np.random.default_rng(seed)
    _normal(rng, before["users"], dim, False)
    e = _normal(rng, len(users), dim)
    _normal(rng, n_users - before["users"] - len(users), dim, False)
    y = _normal(rng, n_items, dim)
    (m, v), (my, vy) = np.zeros((2, *e.shape)), np.zeros((2, *y.shape))
    decay = reg / (n_users + n_items)
    met = peers.add(graph.to_items(e))
    for step in range(1, epochs * -(-n_pairs // batch) + 1):
        short, total = spread(y, met)
        k, c = rng.integers(0, n_pairs, batch), rng.integers(0, n_items, batch)
        mine = (k >= before["pairs"]) & (k < before["pairs"] + len(u))
        k, c = k[mine] - before["pairs"], c[mine]
        a, b = u[k], i[k]
        got, who, change = np.zeros((2, n_items, dim)), a, np.zeros((0, dim))
        if len(k):
            near = graph.of(a)
            fa, gap = e[a] / (layers + 1) + near.to_users(short), total[b] - total[c]
            s = (1 / (1 + np.exp(np.einsum("ij,ij->i", fa, gap))))[:, None] / batch
            hit, g = _summed(np.r_[b, c], np.vstack([-s * fa, s * fa]))
            got[0, hit] = g
            got[1] = near.to_items(-s * gap)
            who, change = _summed(a, -s * gap / (layers + 1))
        short, total = spread(*peers.add(got))
        rate, root, met = lr / (1 - 0.9**step), np.sqrt(1 - 0.999**step), np.zeros_like(y)
        for lo, hi, part in graph.parts:  # so that each part stays in the processor's cache
            g = part.to_users(short)
            at = slice(*np.searchsorted(who, [lo, hi]))
            g[who[at] - lo] += change[at]
            g += decay * e[lo:hi]
            _adam(e[lo:hi], m[lo:hi], v[lo:hi], g, rate, root)
            met += part.to_items(e[lo:hi])
        _adam(y, my, vy, total + decay * y, rate, root)
        met = peers.add(met)
    short, total = spread(y, met)
    peers.close()
    if len(users):
        yield pd.DataFrame({"kind": "user", "id": users, "factors": list(e / (layers + 1) + graph.to_users(short))})
    if me == 0:
        yield pd.DataFrame({"kind": "item", "id": _ids(np.r_[known, [0] * blank], np.arange(n_items) == len(known)), "factors": list(total)})


def _ids(ids: np.ndarray, null: np.ndarray) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(ids.astype("int64"), null))


def _summed(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their rows."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(rows[order], first, axis=0)


def _adam(e: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float, root: float) -> None:
    """Adam's step in place; m and v are the decayed sums, 10 and 1000 times the means. rate and root have the corrections of the means. g is used up."""
    m *= 0.9
    m += g
    v *= 0.999
    g *= g
    v += g
    np.sqrt(v, out=g)
    scale = root * np.sqrt(1000)
    g += 1e-8 * scale
    np.divide(m, g, out=g)
    g *= 0.1 * rate * scale
    e -= g


class _Links:
    """Some users' edges: a matrix, or their items, weights and where each user's begin; every user has an edge."""

    def __init__(self, n_items: int, matrix: np.ndarray | None, item: np.ndarray | None = None, weight: np.ndarray | None = None, first: np.ndarray | None = None):
        self.n_items, self.matrix, self.item, self.weight, self.first = n_items, matrix, item, weight, first

    def to_users(self, y: np.ndarray) -> np.ndarray:
        """The users' weighted sums of their items' rows."""
        if self.matrix is not None:
            return self.matrix @ y
        return np.add.reduceat(self.weight * y[self.item], self.first, axis=0)

    def to_items(self, x: np.ndarray) -> np.ndarray:
        """The items' weighted sums of their users' rows."""
        if self.matrix is not None:
            return self.matrix.T @ x
        row = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(self.item)]))
        hit, total = _summed(self.item, self.weight * x[row])
        out = np.zeros((self.n_items, x.shape[1]))
        out[hit] = total
        return out


class _Bipartite:
    """A task's users, and all items, of the graph with edges weighted 1 / sqrt(degree * degree); u sorted, each user has an edge.

    Where an eighth or more of all pairs are edges (dense) they are a matrix,
    else they are gathered and summed by row. parts: users from, to, and their
    edges. The items' degrees and gram are of all tasks.
    """

    def __init__(self, u: np.ndarray, i: np.ndarray, n_users: int, n_items: int, peers: _Peers, dense: bool, block: int = 1024, block_edges: int = 131_072, max_gram: int = 2_000):
        self.n_items, self.item, self.peers = n_items, i, peers
        degree = peers.add(np.bincount(i, minlength=n_items))
        self.weight = (1 / np.sqrt(np.bincount(u).astype(float)[u] * degree[i]))[:, None]
        self.first = np.searchsorted(u, np.arange(n_users + 1))
        self.matrix = self._gram = None
        if dense:
            self.matrix = np.zeros((n_users, n_items))
            np.add.at(self.matrix, (u, i), self.weight[:, 0])
            if n_items <= max_gram:
                self._gram = peers.add(self.matrix.T @ self.matrix)
        cuts = np.unique(np.r_[np.arange(0, n_users, block), u[np.arange(0, len(u), block_edges)], n_users]).tolist()
        self.parts = [(lo, hi, self._range(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def _range(self, lo: int, hi: int) -> _Links:
        if self.matrix is not None:
            return _Links(self.n_items, self.matrix[lo:hi])
        at = slice(self.first[lo], self.first[hi])
        return _Links(self.n_items, None, self.item[at], self.weight[at], self.first[lo:hi] - self.first[lo])

    def of(self, users: np.ndarray) -> _Links:
        """The edges of these users, who may repeat."""
        if self.matrix is not None:
            return _Links(self.n_items, self.matrix[users])
        n = self.first[users + 1] - self.first[users]
        start = np.cumsum(n) - n
        at = np.repeat(self.first[users] - start, n) + np.arange(n.sum())
        return _Links(self.n_items, None, self.item[at], self.weight[at], start)

    def to_users(self, y: np.ndarray) -> np.ndarray:
        return np.vstack([part.to_users(y) for _, _, part in self.parts])

    def to_items(self, x: np.ndarray) -> np.ndarray:
        return sum((part.to_items(x[lo:hi]) for lo, hi, part in self.parts), np.zeros((self.n_items, x.shape[1])))

    def gram(self, y: np.ndarray) -> np.ndarray:
        """To all tasks' users and back."""
        if self._gram is not None:
            return self._gram @ y
        return self.peers.add(sum((part.to_items(part.to_users(y)) for _, _, part in self.parts), np.zeros_like(y)))


def item_texts(items: DataFrame, content: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """item_id and the text of its content row: the parts that there are, joined; `item <id>` where there is none. Of repeated keys the last by text holds."""
    text = content.select(F.col(key), F.nullif(F.trim(F.concat_ws(" ", *parts)), F.lit("")).alias("text")).groupBy(key).agg(F.max("text").alias("text"))
    return items.join(text, key, "left").select("item_id", F.coalesce("text", F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("text"))


def cosine_top(vectors: DataFrame, key: str, vector: str, k: int, queries: Column | None = None) -> DataFrame:
    """Exact nearest vectors by cosine of the query rows (all by default) against all rows, in blocks of matrix products.

    The vectors are packed into blocks of 512 first, so the product joins
    blocks, not rows, and each pair of blocks gives its k best a query.
    """
    unit_ = F.transform(F.col(vector), lambda x: x / F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, y: a + y * y)))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), unit_.alias("v"), (queries if queries is not None else F.lit(True)).alias("q"))
    blocks = F.lit(max(1, -(-vectors.count() // 512)))
    v = v.withColumn("b", F.pmod(F.xxhash64("k"), blocks))
    pack = lambda d: d.groupBy("b").agg(F.collect_list(F.struct("k", "v")).alias("rows"))  # noqa: E731  512 rows or so each
    left, right = pack(v.where("q")).select(F.col("rows").alias("x")), pack(v).select(F.col("rows").alias("y"))

    def run(batches):
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                a, b = np.array([r["v"] for r in x], float), np.array([r["v"] for r in y], float)
                ka, kb = np.array([r["k"] for r in x]), np.array([r["k"] for r in y])
                s = np.round(a @ b.T, 6)
                s[ka[:, None] == kb[None, :]] = -2
                out = []
                for i in range(len(ka)):
                    top = np.lexsort((kb, -s[i]))[:k]
                    out += [(ka[i], kb[j], s[i, j]) for j in top if s[i, j] > -2]
                yield pd.DataFrame(out, columns=["a", "b", "score"])

    kind = vectors.schema[key].dataType.simpleString()
    found = left.crossJoin(right).mapInPandas(run, f"a {kind}, b {kind}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("rank") <= k)
