"""Near duplicates by a chosen-path set similarity join over word shingles.

Every document is a set of hashed word shingles, embedded into minwise tokens
(the least hash in each of `POSITIONS` bins). Independent trees branch the
documents: a node picks 1 / similarity positions on average, pseudo-randomly
from its own path, and each document goes to the child named by its token
there. Two documents of that similarity stay together along some path with the
probability of a critical branching process, so a tree finds them with a
probability that falls with the depth only as 1 / depth, while dissimilar ones
part at once; `trees` repetitions reach the target recall.

* Nodes of up to `leaf` documents are compared exhaustively, by 128 one-bit
  tokens first: pairs that these show to be far below the threshold go no
  further (a pair at 0.8 is lost by them with a probability of about 1e-7).
* Larger nodes give a star (each member with the node's least) and branch on,
  but for those where a quarter of the members may be near the least: they are
  clusters, which branching would only cut into many nodes of the same copies.
* Clusters, nodes of up to `medium` documents from the second level on, and what
  still is large after `depth` levels are compared exhaustively. Nodes of several
  trees whose leasts are linked are one cluster. A cluster of over `block`
  documents first meets its centre, `centres` times over: members linked to it
  are done with each other. Jaccard distance is a metric, so of the others only
  those within twice the distance can be linked to one that is done; they are
  compared with these, and all others go on to the next centre. So copies of one
  text cost their number, not its square. What is left, and smaller clusters, are
  compared in blocks of `block` documents: a task gets two blocks and counts all
  common shingles by matrix products. It returns no pairs but a forest of the
  links.

Candidates are confirmed on full sets: first each document's best candidate,
then those that still join different components. Documents with equal sets are
one node throughout, however many there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import clear, components, dealt, dropped, lowered, released, sorted_groups, tables, union_all, without, written

WORDS = re.compile(r"[^ \t-\r]+").findall
POSITIONS, TREE_POSITIONS = 128, 64
_MASK = np.uint64(POSITIONS - 1)
_SALTS = np.array([int.from_bytes(hashlib.blake2b(b"bin%d" % i, digest_size=8).digest(), "little") for i in range(POSITIONS)], "u8")
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(b"word%d" % i, digest_size=8).digest(), "little") | 1 for i in range(64)], "u8")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingle_sets(texts: list[str | None], width: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, which is lower-cased already; shorter texts are one shingle, texts without words none."""
    if len(known) > 250_000:
        known.clear()
    out = []
    for t in texts:
        words = WORDS(t) if t else []
        if not words:
            out.append(np.zeros(0, "u8"))
            continue
        w = np.fromiter(map(known.__getitem__, words), "u8", len(words))
        k = min(width, len(w))
        h = np.full(len(w) - k + 1, k, "u8")
        for i in range(k):
            h += mixed(w[i : len(w) - k + 1 + i] + _FACTORS[i]) * _FACTORS[i]
        out.append(np.unique(mixed(h)))
    return out


def minwise(s: np.ndarray) -> np.ndarray:
    """The least element in each bin; for an empty bin the least of all under a hash of the bin's own."""
    out = np.zeros(POSITIONS, "u8")
    bins = (s & _MASK).astype(np.intp)
    out[bins[::-1]] = s[::-1]
    empty = np.ones(POSITIONS, bool)
    empty[bins] = False
    for i in np.flatnonzero(empty):
        out[i] = s[np.argmin(mixed(s ^ _SALTS[i]))]
    return mixed(out ^ _SALTS)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n, digest (of the set; null for an empty one), sig (tree tokens), c1, c2 (128 one-bit tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                rows = []
                for s in shingle_sets(list(part["text"]), width, known):
                    if not len(s):
                        rows.append((0, None, None, 0, 0))
                        continue
                    m = minwise(s)
                    c1, c2 = np.packbits((m & np.uint64(1)).astype("u1")).view("i8").tolist()
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (m[:TREE_POSITIONS] >> np.uint64(32)).astype("u4").view("i4"), c1, c2))
                res = pd.DataFrame(rows, columns=["n", "digest", "sig", "c1", "c2"])
                res.insert(0, "text_key", part["text_key"].to_numpy())
                res.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield res
        known = pdf = part = res = None
        released()

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), lowered(F.col(text_col)).alias("text"))
    return narrow.mapInPandas(run, f"doc_id {kind}, text_key long, n long, digest binary, sig array<int>, c1 long, c2 long")


def _children(node: Column, sig: Column, branches: float) -> Column:
    """The nodes a document goes to from `node`: positions are a hash of the node, the child a hash of node, position and token."""
    low, more = int(branches), round((branches - int(branches)) * 1000)
    at = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(TREE_POSITIONS)).cast("int")
    child = lambda k: F.xxhash64(node, at(k), F.get(sig, at(k)))
    extra = F.when(F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(1000)) < more, child(low))
    return F.array_distinct(F.array_compact(F.array(*[child(k) for k in range(low)], extra)))


def _near(similarity: float) -> Column:
    """Whether sizes and one-bit tokens of a and b leave the similarity possible. The bound lies 5.5 standard deviations off."""
    differ = POSITIONS * (1 - similarity) / 2
    most = int(differ + 5.5 * np.sqrt(differ * (1 + similarity) / 2)) + 1
    sizes = F.least("a.n", "b.n") >= F.lit(similarity) * F.greatest("a.n", "b.n")
    return sizes & (F.bit_count(F.col("a.c1").bitwiseXOR(F.col("b.c1"))) + F.bit_count(F.col("a.c2").bitwiseXOR(F.col("b.c2"))) <= most)


def _bits() -> Column:
    return F.bit_count(F.col("a.c1").bitwiseXOR(F.col("b.c1"))) + F.bit_count(F.col("a.c2").bitwiseXOR(F.col("b.c2")))


def _pairs(a: DataFrame, b: DataFrame, on: Column, similarity: float) -> DataFrame:
    """Candidate pairs (a, b, bits differing), a < b."""
    j = a.alias("a").join(b.alias("b").hint("merge"), on & _near(similarity) & (F.col("a.digest") != F.col("b.digest")))
    return j.select(F.least("a.digest", "b.digest").alias("a"), F.greatest("a.digest", "b.digest").alias("b"), _bits().alias("bits"))


def candidates(nodes: DataFrame, similarity: float, trees: int, leaf: int, depth: int, settled: float = 0.25, medium: int = 1024) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs from all trees, and the members (first, digest) of nodes to be compared in blocks, by the node's least."""
    branches = 1 / similarity
    carried = ["digest", "n", "c1", "c2"]
    roots = F.array(*[F.lit(-1 - t).cast("long") for t in range(trees)])
    front = nodes.select(*carried, "sig", F.explode(roots).alias("root")).select(F.explode(_children(F.col("root"), F.col("sig"), branches)).alias("node"), *carried)
    found, late, scratch = [], [], []
    for level in range(1, depth + 1):
        many = front.groupBy("node").agg(F.count("*").alias("members"), F.min(F.struct(*carried)).alias("first")).where("members > 1")
        many = written(many, f"path-nodes{level}").select("node", "members", "first.*")
        met = front.alias("a").join(many.alias("b").hint("merge"), F.col("a.node") == F.col("b.node"))
        own = [F.col(f"a.{c}") for c in ("node", *carried)]
        table = written(met.select(*own, "b.members", F.col("b.digest").alias("first"), _near(similarity).alias("near"), _bits().alias("bits")), f"path-rows{level}")
        small = table.where(F.col("members") <= leaf).select("node", *carried)
        found.append(_pairs(small, small, (F.col("a.node") == F.col("b.node")) & (F.col("a.digest") < F.col("b.digest")), similarity))
        large = table.where(F.col("members") > leaf)
        if large.isEmpty():
            scratch += [many, table]
            break
        found.append(large.where("near and digest <> first").select(F.col("first").alias("a"), F.col("digest").alias("b"), "bits"))
        if level == depth:
            late.append(large.select("first", "digest"))
            scratch += [many, table]
            break
        shares = written(large.groupBy("node").agg(F.avg(F.col("near").cast("double")).alias("share")), f"path-shares{level}")
        scratch += [many, table, shares]
        split = large.join(shares.hint("merge"), "node").withColumn("done", (F.col("share") >= settled) | ((F.col("members") <= medium) & F.lit(level >= 2)))
        late.append(split.where("done").select("first", "digest"))
        front = split.where("not done").select("node", *carried).join(nodes.select("digest", "sig").hint("merge"), "digest")
        front = front.select(F.explode(_children(F.col("node"), F.col("sig"), branches)).alias("node"), *carried)
    clusters = written(union_all(late).distinct(), "clusters") if late else None
    pairs = written(union_all(found).groupBy("a", "b").agg(F.min("bits").alias("bits")), "candidates")
    dropped(*scratch)
    return pairs, clusters


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """digest and set of the wanted digests; wanted: (digest, doc_id, text_key), one document each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                sets = shingle_sets(list(part["text"]), width, known)
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), "items": [s.view("i8") for s in sets]})
        known = pdf = part = sets = None
        released()

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    one = wanted.select("digest", F.col("doc_id").alias("d"), F.col("text_key").alias("k")).hint("merge")
    found = own.join(one, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # rows that repeat both id and text give the same set twice
    sets = found.select("digest", lowered(F.col("text")).alias("text")).mapInPandas(run, "digest binary, items array<long>")
    return written(sets, "shingle-sets").dropDuplicates(["digest"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    a = sets.select(F.col("digest").alias("a"), F.col("items").alias("x")).hint("merge")
    b = sets.select(F.col("digest").alias("b"), F.col("items").alias("y")).hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(b, "b").join(a, "a").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, trees: int = 12, leaf: int = 48, depth: int = 8, block: int = 1024, centres: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_key (xxhash64 of the text), n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; the set
    holds the distinct shingles of `width` words, or the whole sequence where
    there are fewer. Documents are linked where |A and B| / |A or B| >=
    similarity, and component_id is the smallest id that links reach. kept marks
    one row a component, one with that id. Null, empty and wordless texts have
    no shingles and are linked with nothing, so they are kept. Null ids are the
    largest. Repeated rows, and ties in id, are linked, and one of them is kept.
    Whole texts are read, very long ones too; other columns may have any names.
    An empty table stays empty.
    """
    percent = round(100 * similarity)
    base = written(signatures(docs, width, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    full = base.where("digest is not null")
    nodes = written(full.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("n", "c1", "c2")], F.min(F.struct("doc_id", "text_key")).alias("who"), F.first("sig").alias("sig")), "set-nodes")
    pairs, clusters = candidates(nodes, similarity, trees, leaf, depth)
    active = pairs.select(F.explode(F.array("a", "b")).alias("digest"))
    if clusters is not None:
        active = active.unionByName(clusters.select("digest"))
    wanted = written(nodes.select("digest", "who.doc_id", "who.text_key").join(active.distinct().hint("merge"), "digest"), "active")
    if wanted.isEmpty():
        comp = wanted.select(F.col("digest").alias("node"), F.col("digest").alias("component"))
    else:
        sets = written(_sets(docs, wanted, width, id_col, text_col), "active-sets")
        best = pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
        links = written(_confirm(best, sets, percent), "links")
        comp = components(links)
        if clusters is not None:
            links = links.unionByName(_clustered(clusters, comp, sets, percent, block, centres))
            dropped(comp)
            comp = components(links)
        more = written(_confirm(_apart(pairs.select("a", "b"), comp), sets, percent), "links")
        if not more.isEmpty():
            dropped(comp)
            comp = components(links.unionByName(more))
        dropped(sets, pairs, clusters, more)
    named = full.join(comp.select(F.col("node").alias("digest"), "component").hint("merge"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    named = written(named.select("uid", "doc_id", "text_key", "n", "component"), "named")
    dropped(nodes, wanted)
    least = written(named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))).alias("top")), "least")
    out = named.join(least, "component").select("doc_id", "text_key", "n", F.col("top.doc_id").alias("component_id"), (F.col("uid") == F.col("top.uid")).alias("kept"))
    alone = base.where("digest is null").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone).select(F.col("doc_id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), "component_id", "kept")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")).hint("merge")
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return j.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _clustered(clusters: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, block: int, centres: int) -> DataFrame:
    """Links within clusters, as many as join what links join there: a written table (a, b)."""
    of = comp.select(F.col("node").alias("first"), "component").hint("merge")
    own = clusters.join(of, "first", "left").select(F.coalesce("component", "first").alias("cluster"), "digest").distinct()
    own = written(own, "cluster-rows")
    count = own.groupBy("cluster").count()
    few = own.join(count.where(F.col("count") <= block).hint("merge"), "cluster", "left_semi")
    jobs, found = [few.select(F.col("cluster").alias("name"), F.lit(0).alias("side"), "digest")], []
    left, scratch = written(own.join(count.where(F.col("count") > block).hint("merge"), "cluster", "left_semi"), "cluster-large"), [own]
    for turn in range(centres):
        if left.isEmpty():
            break
        scratch.append(left)
        centre = written(left.groupBy("cluster").agg(F.min_by("digest", F.xxhash64("digest", F.lit(turn))).alias("centre")), "cluster-centres")
        given = sets.select(F.col("digest").alias("centre"), F.col("items").alias("y")).hint("merge")
        centre = written(centre.join(given, "centre"), "cluster-centre-sets")
        both = F.size(F.array_intersect("items", "y"))
        # members' distances to the centre: within the link's, within twice that, and beyond
        far = left.join(sets.hint("merge"), "digest").join(centre.hint("merge"), "cluster").select("cluster", "digest", "centre", both.alias("both"), (F.size("items") + F.size("y")).alias("all"))
        union = F.col("all") - F.col("both")
        rank = F.when(100 * F.col("both") >= percent * union, 0).when(100 * F.col("both") >= (2 * percent - 100) * union, 1).otherwise(2)
        seen = written(far.select("cluster", "digest", "centre", rank.alias("rank")), "cluster-ranks")
        found.append(seen.where("rank = 0 and digest <> centre").select(F.col("centre").alias("a"), F.col("digest").alias("b")))
        ring = seen.where("rank = 1").select("cluster").distinct()
        met = seen.where("rank < 2").join(ring.hint("merge"), "cluster", "left_semi")
        jobs.append(met.select(F.xxhash64("cluster", F.lit(turn)).cast("string").cast("binary").alias("name"), F.col("rank").alias("side"), "digest"))
        left = written(seen.where("rank > 0").select("cluster", "digest"), "cluster-large")
    scratch.append(left)
    jobs.append(left.select(F.col("cluster").alias("name"), F.lit(0).alias("side"), "digest"))
    out = written(union_all([*found, _in_blocks(union_all(jobs), sets, percent, block)]), "links")
    dropped(*scratch)
    return out


def _in_blocks(jobs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of each job (name): among its rows of side 0, or between those and its rows of side 1 where it has such."""
    jobs = written(jobs, "block-jobs")
    per = jobs.groupBy("name").agg(*[(F.floor((F.count_if(F.col("side") == k) - 1) / block) + 1).cast("int").alias(f"blocks{k}") for k in (0, 1)])
    rows = jobs.join(written(per, "block-counts").hint("merge"), "name")
    two = F.col("blocks1") > 0
    mine, other = F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1")), F.when(two & (F.col("side") == 0), F.col("blocks1")).otherwise(F.col("blocks0"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("digest", F.lit(7)), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    first, second = F.when(two, F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).otherwise(F.least("own", "other")), F.when(two, F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))).otherwise(F.greatest("own", "other"))
    side = F.when(two, F.col("side")).otherwise(F.when(F.col("own") <= F.col("other"), 0).otherwise(1))
    rows = rows.select(F.xxhash64("name", first, second).alias("key"), side.alias("side"), "digest").join(sets.hint("merge"), "digest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, over in sorted_groups(batches, 1 << 60):
            assert not over
            for _, group in part.groupby("key", sort=False):
                found = block_links(group["digest"].tolist(), group["items"].tolist(), group["side"].to_numpy(), percent)
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return dealt(rows).mapInPandas(run, "a binary, b binary")


def block_links(names: list[bytes], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """A forest of the links between the sets of side 0 and side 1, or among all where there is no side 1."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    size = np.array([len(s) for s in sets])
    items, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    # shingles of one set only are in no intersection
    many = np.bincount(place)[place] > 1
    place, row = np.unique(place[many], return_inverse=True)[1], row[many]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width, step = (int(place[-1]) + 1 if len(place) else 0), 1024
    at = np.full((2, len(sets)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    for k in range(0, width, step):
        lo, hi = np.searchsorted(place, [k, k + step])
        one, two = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        for matrix, index in ((one, at[0]), (two, at[1])):
            own = index[row[lo:hi]]
            matrix[own[own >= 0], (place[lo:hi] - k)[own >= 0]] = 1
        common += one @ two.T
    linked = (np.nonzero(100 * common[i] >= percent * (size[left[i]] + size[right] - common[i]))[0] for i in range(len(left)))
    up = list(range(len(sets)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, near in zip(left.tolist(), linked, strict=True):
        for y in right[near].tolist():
            a, b = find(x), find(y)
            if a != b:
                up[b] = a
                out.append((names[x], names[y]))
    return out


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with all columns: one of each component.

    Rows that repeat both id and text stay or go together; exact dedup goes first.
    """
    key = [F.col(id_col).alias("gone_id"), F.col("text_key").alias("gone_key")]
    others = tables(docs.sparkSession)
    named = groups(docs, id_col=id_col, text_col=text_col, **options).groupBy(*key).agg(F.bool_or("kept").alias("kept"))
    gone = written(named.where("not kept").drop("kept"), "near-dropped")
    clear(docs.sparkSession, keep=others | {gone._scratch})
    key = F.xxhash64(f"d.{text_col}")
    return without(docs, gone, F.col(f"d.{id_col}").eqNullSafe(F.col("g.gone_id")) & (key == F.col("g.gone_key")), key, F.col("g.gone_key"))
