import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, line_dedup, near_dedup
from lodestone.llm.shared import components

from .common import LOWER, Sets, documents, empty, prose, shingles


def test_exact_groups_match_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    out = exact_dedup.radix_groups(docs, first=4, growth=4).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_keeps_all_columns_of_the_rows_that_stay(spark):
    docs = documents(spark)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({(r.text or "").translate(LOWER) for r in docs.select("text").collect()})


def test_exact_parts_long_texts_at_any_byte(spark):
    base = "é" * 5000
    texts = [base, base[:-1] + "e", base, "x" + base[1:], base[:2500] + "É" + base[2501:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.radix_groups(df).collect()}
    assert out == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1), 4: (4, 1)}  # É is no ASCII letter


def test_empty_tables(spark):
    assert exact_dedup.radix_groups(empty(spark)).count() == 0
    assert near_dedup.groups(empty(spark)).count() == 0
    assert line_dedup.dedup_report(empty(spark)).count() == 0


@pytest.mark.parametrize("leaf,block", [(48, 2048), (2, 4)])
def test_near_components_match_brute_force(spark, leaf, block):
    docs = documents(spark).where("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, links = [(i, shingles(t, 4)) for i, t in rows], Sets()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.join(i, j)
    out = near_dedup.groups(docs, width=4, leaf=leaf, block=block).collect()
    assert len(out) == len(rows)
    size = dict(sets)
    for r in out:
        assert r.component_id == links.find(r.doc_id) and r.n_shingles == len(size[r.doc_id])
    assert sum(r.kept for r in out) == len({links.find(i) for i, _ in rows})


def test_near_finds_a_large_cluster_and_its_outliers(spark):
    rng = random.Random(5)
    base = prose(rng, 150).split()
    rows, sets = [], []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 4, 7])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        sets.append(shingles(rows[-1][1], 4))
    links = Sets()
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links.join(i, j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.groups(df, width=4, leaf=16, block=64).collect()}
    assert got == {i: links.find(i) for i in range(len(rows))}


def test_near_drops_all_but_one_of_a_group(spark):
    docs = exact_dedup.drop_copies(documents(spark))
    out = near_dedup.drop_near(docs, width=5)
    assert out.columns == docs.columns
    named = near_dedup.groups(docs, width=5)
    assert out.count() == named.where("kept").count()


def test_signatures_do_not_depend_on_batches():
    known = near_dedup.WordHashes()
    a = near_dedup.shingle_sets(["a b c d e", "", None, "a b"], 4, known)
    b = near_dedup.shingle_sets(["a b c d e"], 4, near_dedup.WordHashes())
    assert (a[0] == b[0]).all() and len(a[0]) == 2 and len(a[1]) == len(a[2]) == 0 and len(a[3]) == 1
    assert (near_dedup.minwise(a[0]) == near_dedup.minwise(b[0])).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_keys_match_dynamic_programming(edits):
    rng = random.Random(edits)
    a, b = [], []
    for _ in range(800):
        x = [rng.choice("abé") for _ in range(rng.randint(0, 25))]
        y = list(x)
        for _ in range(rng.randint(0, edits + 2)):
            at = rng.randint(0, len(y))
            rng.choice([lambda: y.insert(at, "z"), lambda: y and y.pop(min(at, len(y) - 1)), lambda: y and y.__setitem__(min(at, len(y) - 1), "q")])()
        a.append("".join(x))
        b.append("".join(y))
    near = [edit_distance(x, y) <= edits for x, y in zip(a, b)]
    assert line_dedup.within(a, b, edits).tolist() == near
    for x, y, ok in zip(a, b, near):
        short, long = sorted((x, y), key=len)
        if ok and x != y:
            which, key, role, _, _ = line_dedup.keyed([short, long], np.array([1, 2]), edits)
            assert set(key[which == 0].tolist()) & set(key[which == 1].tolist())
            which, key, role, at, end = line_dedup.keyed([short, long], np.array([3, 3]), edits)
            assert set(key[(which == 0) & (role & 1 != 0)].tolist()) & set(key[(which == 1) & (role & 2 != 0)].tolist())
            assert all(len(set(key[which == w].tolist())) <= (edits + 1) ** 2 * (edits + 1) for w in (0, 1)) and (at <= end).all()


@pytest.mark.parametrize("crowd,room", [(64, 4096), (4, 16)])
def test_line_classes_match_brute_force(spark, crowd, room):
    rng = random.Random(3)
    base = [prose(rng, 6) for _ in range(12)] + [f"Order number {rng.randrange(10**4):04d} was processed" for _ in range(40)]
    docs = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        docs.append((i, "\n".join([*lines, "short"])))
    docs += [(97, None), (98, ""), (99, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    occ = [(i, k, x) for i, t in docs if t is not None for k, x in enumerate(t.split("\n")) if len(x) >= 16]
    lines, links = sorted({x for _, _, x in occ}), Sets()
    for i, x in enumerate(lines):
        links.find(x)
        for y in lines[:i]:
            if abs(len(x) - len(y)) <= 2 and edit_distance(x, y) <= 2:
                links.join(x, y)
    first, want = {}, {i: [0, 0, 0] for i, _ in docs}
    seen = set()
    for i, k, x in sorted(occ):
        want[i][0] += 1
        root = links.find(x)
        if root in first:
            want[i][1] += 1
            want[i][2] += x in seen
        first.setdefault(root, (i, k))
        seen.add(x)
    got = {r.doc_id: [r.n_long, r.n_dropped, r.n_exact] for r in line_dedup.dedup_report(df, crowd=crowd, room=room).collect()}
    assert got == want


def test_crowded_lines_are_linked_by_true_links_only(spark):
    # a-b and b-c are 2 edits apart, a-c 4; beside the shared middle segment a and c differ by 2 only
    rows = []
    for k in range(12):
        middle = "".join(chr(0x4E00 + 8 * k + j) for j in range(8))
        rows += ["abcdefg" + middle + "hABCDEFGH", "abcdefgh" + middle + "ABCDEFGH", "abXdefgh" + middle + "ABCDEFYH"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, text string").coalesce(1)
    for k in range(12):
        a, b, c = rows[3 * k : 3 * k + 3]
        assert edit_distance(a, b) == edit_distance(b, c) == 2 and edit_distance(a, c) == 4
    lines, links = rows, Sets()
    for i, x in enumerate(lines):
        links.find(x)
        for y in lines[:i]:
            if edit_distance(x, y) <= 2:
                links.join(x, y)
    want = len(rows) - len({links.find(x) for x in rows})
    assert line_dedup.dedup_report(df, crowd=2).agg(F.sum("n_dropped")).first()[0] == want


def test_short_lines_are_judged_by_equality(spark):
    df = spark.createDataFrame([(1, "Share this\n\n  \nReply"), (2, "Share this\nShare thiz\n\n  \na line that is long enough"), (3, "a line that is long enouhg\nShare this\nReply")], "doc_id long, text string")
    got = {r.doc_id: (r.n_long, r.n_short, r.n_dropped, r.n_exact, r.n_near) for r in line_dedup.dedup_report(df, short=True).collect()}
    assert got == {1: (0, 2, 0, 0, 0), 2: (1, 2, 1, 1, 0), 3: (1, 2, 3, 2, 1)}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(df, short=True).collect()}[2] == "Share thiz\n\n  \na line that is long enough"


def test_drop_lines_leaves_first_occurrences(spark):
    line = "a line that is long enough to be judged"
    df = spark.createDataFrame([(1, f"{line}\nshort"), (2, f"other text that stays in here\n{line}!\nshort")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert out == {1: f"{line}\nshort", 2: "other text that stays in here\nshort"}


def test_lines_of_odd_rows(spark):
    """Null and repeated ids, null texts, clashing names: counted and dropped alike."""
    line, other = "a line that is long enough to be judged", "another line, quite unlike the first one"
    rows = [(None, f"{line}\n{other}"), (None, line), (5, f"{other}\n{line}!"), (5, f"{other}\n{line}!"), (7, None), (8, ""), (9, line * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS line", "3 AS class", "4 AS row", "5 AS uid", "6 AS h")
    report = line_dedup.dedup_report(df)
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = [r.text for r in out.collect()]
    assert sorted(t for t in texts if t) == sorted([f"{other}\n{line}!", line * 3000]) and texts.count(None) == 1 and texts.count("") == 4
    lines = sum(len((t or "").split("\n")) for _, t in rows if t)
    assert lines - sum(len(t.split("\n")) for t in texts if t) == report.agg(F.sum("n_dropped")).first()[0] == 5
    assert {r.doc_id: r.n_lines for r in report.collect()} == {None: 3, 5: 4, 7: 0, 8: 1, 9: 1}
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_large_cluster_by_its_centres(spark):
    """A cluster of many blocks: members near the centre, in its ring, and beyond; links as by brute force."""
    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 6, 8, 11])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 4) for _, t in rows]
    links = Sets()
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links.join(i, j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.groups(df, width=4, leaf=8, block=32, centres=3).collect()}
    assert got == {i: links.find(i) for i in range(len(rows))} and len(set(got.values())) > 1


def test_null_ids_are_linked(spark):
    text = prose(random.Random(1), 40)
    df = spark.createDataFrame([(None, text), (None, text), (4, text + " x"), (9, None), (None, None)], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.groups(df, width=4).collect())
    assert out == [(-1, -1, True), (-1, 4, False), (-1, 4, False), (4, 4, True), (9, 9, True)]


def test_kernels_travel_without_the_package(tmp_path):
    """What executors unpickle must not import the package: its kernels run in a process that lacks it."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lodestone.llm import license_scan, packing, url_filter, warc  # noqa: F401

    def work():
        which, key, _, _, _ = line_dedup.keyed(["a line of text", "a line of test"], np.array([3, 3]), 2)
        near = line_dedup.within(["abc"], ["abd"], 2).tolist()
        sets = near_dedup.shingle_sets(["a b c d e f"], 4, near_dedup.WordHashes())
        seg = url_filter.Segmenter({"free": 2.0, "bets": 2.0})
        found = license_scan.Recogniser(license_scan.SENTENCES, license_scan.RULES).identify("Released under the MIT License.")
        return len(set(key[which == 0].tolist()) & set(key[which == 1].tolist())) > 0, near, len(sets[0]), seg.split("freebets"), found[0][0], packing.cut_points.__name__

    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    code = "import sys, pickle; from pyspark import cloudpickle; sys.path = [p for p in sys.path if 'repo' not in p and p]; print(pickle.load(open(sys.argv[1], 'rb'))()); assert not any(m.startswith('lodestone') for m in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code, str(tmp_path / "work")], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert got.returncode == 0, got.stderr
    assert got.stdout.strip() == "(True, [True], 3, ('free', 'bets'), 'notice:MIT', 'cut_points')"


def test_block_links_is_a_forest():
    sets = [np.arange(k, k + 100) for k in (0, 2, 4, 300)]
    names = [bytes([k]) for k in range(4)]
    assert len(near_dedup.block_links(names, sets, np.zeros(4, int), 80)) == 2
    assert near_dedup.block_links(names, sets, np.array([0, 0, 1, 1]), 80)[0][1] == b"\x02"
