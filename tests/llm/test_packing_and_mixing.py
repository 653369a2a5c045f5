import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing

from .common import WORDS, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk,length", [(1 << 20, 2048), (3000, 256)])
def test_pieces_hold_each_id_once(spark, chunk, length):
    from tokenizers import Tokenizer

    docs = documents(spark).where("doc_id is not null")
    tok = Tokenizer.from_file(PATH)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    got = packing.pack(docs, PATH, length=length, chunk=chunk).toPandas()
    for i, copies in want.items():
        own = got[got.doc_id == i].sort_values(["start", "sequence_id"])
        assert own.length.sum() == sum(map(len, copies)) and (own.doc_tokens == len(copies[0])).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(copies[0][r.start : r.start + r.length].tobytes())
    total = used = 0
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        n = int(seq.length.sum())
        assert n <= length and seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1].tolist()]
        used += n
        total += n if n & (n - 1) == 0 else length
    assert total <= used * 1.1


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        pos = np.r_[0, np.cumsum(rng.integers(1, 9, 40))]
        pen = np.r_[0.0, rng.choice([0.0, 2.0, 24.0], 39), 0.0]
        cost = lambda n: packing.WINDOW + (0 if n & (n - 1) == 0 else 32 - n)
        best = [0.0] + [np.inf] * 40
        for i in range(1, 41):
            best[i] = min(best[j] + cost(pos[i] - pos[j]) + pen[i] for j in range(i) if pos[i] - pos[j] <= 32)
        cuts = packing.best_cuts(pos, pen, 32)
        assert abs(sum(cost(pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) - best[-1]) < 1e-9
        assert cuts[0] == 0 and cuts[-1] == 40


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for text in ["Ἀθήνα ΣΑΣ İstanbul naïve. café!! <|endoftext|> x's don't. I'LL 'S ½ ² 12.5% ÆÞ ǅ Ĳ ªº éa.  x\u00a0y\u3000z\x1cw 日本語. abc.,! .. it's, ﬁne", "ÀÉ.\u0301 á.", "ß ẞ ĸŉ", "", " \n"]:
        assert own.encode(text, b"").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_edges(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.length) for r in packing.pack(df, PATH).orderBy("length").collect()] == [(None, 1), (None, 3)]
    ids = packing.pack(df, PATH, with_ids=True).orderBy("length").collect()
    assert ids[0].ids == [1]


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text", "source").collect()
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(WORDS(r.text or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    want = mixing.targets(names, np.array([size[s] for s in names]))
    assert abs(want.sum() - 1.5 * sum(size.values())) < 1e-6 and all(t <= 2 * size[s] + 1e-9 for s, t in zip(names, want))
    source = {(r.doc_id, len(WORDS(r.text or ""))): r.source for r in rows}
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert r.size == len(WORDS(next(x.text for x in rows if x.doc_id == r.doc_id) or "")) and 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(want[names.index(s)])
        taken[s] += r.taken
    for s, t in zip(names, want):
        assert abs(taken[s] - t) <= 40


def test_sources_below_a_block_meet_their_targets(spark):
    rows = [(i, "w " * 500, "big") for i in range(40)] + [(100 + i, "a b c", f"small{i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, block=1900).toPandas()  # the small sources' targets are 6
    small = out[out.doc_id >= 100]
    assert (small.target == 6).all() and (small.taken == 6).all()
    assert abs(out[out.doc_id < 100].taken.sum() - out[out.doc_id < 100].target.iloc[0]) <= 1


def test_words_stand_in_the_slots_of_their_blocks(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 10 else f"rare{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    block = 24
    out = mixing.mix(df, block=block).toPandas()
    out["source"] = [rows[i][2] for i in out.doc_id]
    used = {}  # slot: sources and words that lie in it, of documents within one slot
    for r in out.itertuples():
        for n, a, b in ((r.first_pass, r.first_from, r.first_to), (r.second_pass, r.second_from, r.second_to)):
            assert (n > 0) == (a == a) == (b == b) and (not n or b == a or n > 1)
            for slot in {a, b} if n else ():
                used.setdefault(int(slot), []).append((r.source, n if a == b else 0))
    assert all(len({s for s, _ in x}) == 1 and sum(n for _, n in x) <= block for x in used.values())
    taken = out.groupby("source").taken.sum()
    assert {s: sum(x[0][0] == s for x in used.values()) for s in taken.index} == {s: -(-n // block) for s, n in taken.items()}
    mixed = [(r.doc_id, r.source) for r in mixing.mixed_documents(df, block=24).collect()]
    want = sorted((slot, i) for r in out.itertuples() for slot, i in ((r.first_from, r.doc_id), (r.second_from, r.doc_id)) if slot == slot)
    assert sorted(i for i, _ in mixed) == sorted(i for _, i in want)
    begins = {}
    for slot, i in want:
        begins.setdefault(i, []).append(slot)
    assert (s := [begins[i].pop(0) for i, _ in mixed]) == sorted(s)


def test_mixed_documents_interleave_the_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(600)], "doc_id long, text string, source string")
    src = [r.source for r in mixing.mixed_documents(df, weights=(1.0, 1.0), share=1.0, block=10).collect()]
    assert len(src) == 600 and all(abs(src[:n].count("a") - n / 2) <= 8 for n in range(0, 600, 20))


def test_mix_does_not_depend_on_partitions(spark):
    docs = documents(spark)
    rows = lambda d: [tuple(map(str, r)) for r in mixing.mixed_documents(d, block=50).select("doc_id", "text", "source").collect()]
    assert rows(docs) == rows(docs.repartition(9)) == rows(docs.orderBy("text"))


def test_points_are_exact_far_out(spark):
    t = np.array([3, 1])
    far = [10**15 + k for k in range(1000)]
    want = [0 if (x * 0x9E3779B97F4A7C15 % 2**64) < 3 * 2**62 else 1 for x in far]
    point = np.array(far, "u8") * mixing.GOLDEN
    assert (point >= np.uint64(3 * 2**62)).astype(int).tolist() == want and abs(np.mean(want) - 0.25) < 0.01
    assert t.sum() == 4


def test_water_filling():
    t = mixing.targets(["a", "b", "c"], np.array([10, 1000, 1000]))
    assert t[0] == 20 and t[1:] == pytest.approx([(3015 - 20) / 3, 2 * (3015 - 20) / 3])
    assert mixing.targets(["a"], np.array([0])).tolist() == [0.0]


def test_schedule_prefixes_are_balanced(spark):
    t = np.array([5, 1, 2, 2])
    rows = mixing.schedule(spark, t, 20_000).orderBy("slot").collect()
    src = np.array([r.src for r in rows])
    for n in (10, 100, 1000, 20_000):
        assert np.abs(np.bincount(src[:n], minlength=4) - n * t / t.sum()).max() <= 3 + np.log2(n) / 2
    seen = [0] * 4
    for r in rows:
        assert r.rank == seen[r.src]
        seen[r.src] += 1


def test_mixed_documents_hold_the_words_taken(spark):
    docs = documents(spark)
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns
    words = m.select(F.sum(mixing.sizes(m)).alias("n")).first()["n"]
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    text = {r.text for r in docs.select("text").collect() if r.text}
    assert all(any(t.startswith(r.text) for t in text) for r in m.select("text").collect())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, max_sources=2)
