"""Operators on hand-checkable rows and by their properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats as S
from lodestone.operators import entities, evaluate, identity, panel, quality, rankers, sequences, split


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_duplicate_flags(spark):
    rows = [(1, "a", "h", 8.0, "d", "x"), (2, "a", "h", 8.0, "d", "x"), (3, "a", "h", 9.0, "d", "x"), (4, "a", "h", 8.0, "d", "y"), (5, None, "h", 8.0, "d", "x"), (6, None, "h", 8.0, "d", "x")]
    df = frame(spark, rows, "i int, n string, h string, r double, d string, s string")
    got = {r.i: r.is_dup for r in quality.duplicate_flags(df, ["n", "h", "r", "d"], ["i"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}
    near = {r.i: r.is_dup for r in quality.duplicate_flags(df, ["n", "h", "d"], ["i"]).collect()}
    assert near == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_completeness_of_absent_columns(spark):
    df = frame(spark, [("a",), ("",), ("n/a",), (None,)], "n string")
    got = {r.column: (r.present, r.n_missing, r.missing_pct) for r in quality.completeness(df, ["n", "z"], "n").collect()}
    assert got == {"n": (True, 3, 75.0), "z": (False, None, None)}


def test_resolution(spark):
    rows = [("Khách sạn Pullman Vũng Tàu", "Vũng Tàu"), ("Pullman Vung Tau", "Vũng Tàu"), ("RAON Hotel", "Quy Nhơn"), ("Raon Villa", "Đà Lạt"), ("Sun Hotel", "Huế"), ("Sun Villa", "Huế"), ("Sun", "Huế"), ("Sun Hotels Hotel", "Huế")]
    got = [r.entity_key for r in entities.resolve(frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, name string, city string"), "name", "city").orderBy("i").collect()]
    assert got[0] == got[1] == "vung tau | pullman | hotel" and got[2] != got[3]
    assert got[4] == got[6] == got[7] == "hue | sun | hotel" and got[5] == "hue | sun | villa"


def test_release_keeps_names_apart(spark):
    rows = [("Nam", "Sun Hotel", "e1", "Huế", 8.0, "2020-01-02", "x"), ("Nam", "Sun  Hotel", "e1", "Huế", 9.0, "2020-01-03", "y"), ("Lan", "Sun Hotel", "e1", "Hue", 9.0, "2020-01-03", "y")]
    df = frame(spark, rows, "CustomerName string, NameHotel string, entity_key string, Location string, Rating_clean double, Date_parsed string, source string").withColumn("Date_parsed", F.col("Date_parsed").cast("date"))
    t = entities.release(df, "salt")
    assert t["hotels"].collect() == [("H0001", "Sun Hotel", "Huế")] and t["users"].count() == 2
    assert not {"CustomerName", "NameHotel"} & set(t["interactions"].columns) and set(t["mapping"].columns) == {"CustomerName", "user_id"}


@pytest.mark.parametrize("parts", [1, 5])
def test_folds(spark, parts):
    rows = [("u", "a", 1), ("u", "b", 2), ("u", "c", 3), ("u", "d", 3), ("v", "a", 1), ("v", "b", 2), ("v", "c", 3)]
    df = frame(spark, rows, "user_id string, item_id string, ts int").repartition(parts)
    assert {(r.item_id, r.fold) for r in split.temporal_folds(df, "user_id", ["ts", "item_id"]).collect()} == {("a", "train"), ("b", "train"), ("c", "val"), ("d", "test")}
    r = split.random_folds(df, "user_id", ["item_id"]).groupBy("fold").count().collect()
    assert {x.fold: x["count"] for x in r} == {"train": 2, "val": 1, "test": 1}


def test_concentration(spark):
    for values, want in (([1, 1, 1, 1], 0.0), ([0, 0, 0, 10], 0.75), ([1, 2, 3, 4], 0.25), ([], 0.0)):
        df = frame(spark, [(float(v),) for v in values], "v double")
        assert S.gini(df, "v").first().gini == want
    assert S.head_share(frame(spark, [(4.0,), (3.0,), (2.0,), (1.0,)], "v double"), "v").first().asDict() == {"n_head": 1, "share_pct": 40.0}


X = [[1, 1, 0, 0], [1, 0, 1, 0], [0, 1, 1, 1]]


def pairs(spark):
    return frame(spark, [(u, i) for u, row in enumerate(X) for i, v in enumerate(row) if v], "user_id long, item_id long")


def matrix(scores, shape=(3, 4)):
    m = np.zeros(shape)
    for r in scores.collect():
        m[r.user_id, r.item_id] = r.score
    return m


def test_rankers_match_dense_algebra(spark):
    p, x = pairs(spark), np.array(X, float)
    n, c = x.sum(0), x.sum(1)
    item = x.T @ x / np.sqrt(np.outer(n, n))
    np.fill_diagonal(item, 0)
    assert np.allclose(matrix(rankers.itemknn(p)), x @ item)
    user = x @ x.T / np.sqrt(np.outer(c, c))
    np.fill_diagonal(user, 0)
    want = (user @ x) * (x == 0)
    assert np.allclose(matrix(rankers.userknn(p)), want) and np.allclose(matrix(rankers.userknn_neighbours(p, 5)), want)
    for form in ("row", "column"):
        inv = np.linalg.inv(x.T @ x + np.eye(4))
        d = np.diag(inv)
        b = -inv / (d[:, None] if form == "row" else d[None, :])
        np.fill_diagonal(b, 0)
        assert np.allclose(matrix(rankers.ease(p, 1.0, form)), x @ b)
    assert np.allclose(matrix(rankers.sansa(p, 1.0)), matrix(rankers.ease(p, 1.0, "column")))
    pop = {r.item_id: r.score for r in rankers.popularity(p).collect()}
    assert pop == {0: 2, 1: 2, 2: 2, 3: 1}
    top = rankers.mostpop_top(p, 1).collect()
    assert {(r.user_id, r.item_id) for r in top} == {(0, 2), (1, 1), (2, 0)}
    with pytest.raises(ValueError):
        rankers.ridge_weights(p, 1.0, "none")
    with pytest.raises(ValueError):
        rankers.ridge_weights(p, 1.0, max_items=2)


def test_tfidf(spark):
    docs = frame(spark, [(0, "aa bb aa"), (1, "bb cc"), (2, "")], "i int, t string")
    w = {(r.item, r.term): r.weight for r in rankers.tfidf(docs, "i", "t").collect()}
    assert w[0, "aa"] == pytest.approx(2 / 3 * 1.693147, abs=1e-5) and w[1, "bb"] == pytest.approx(1.287682 / 2, abs=1e-5)
    s = rankers.content_scores(frame(spark, [(7, 0)], "user_id int, item_id int"), rankers.tfidf(docs, "i", "t"))
    got = {r.item_id: r.score for r in s.collect()}
    assert got[0] == pytest.approx(1) and set(got) == {0, 1}


def test_weights_and_scaling(spark):
    df = frame(spark, [(2.0,), (6.0,), (11.0,)], "n double")
    assert [round(r[0], 6) for r in df.select(rankers.adaptive_weight(F.col("n"), 6.0, 1.0, 0.85)).collect()] == [0.852698, 0.925, 0.998996]
    s = frame(spark, [(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 5.0)], "user_id int, item_id int, score double")
    assert {(r.user_id, r.item_id): r.score for r in rankers.minmax(s).collect()} == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 0.5, (2, 1): 0.0}
    f = frame(spark, [(1.0, None), (None, 1.0), (None, None), (1.0, 0.0)], "a double, b double").select(rankers.fused(F.col("a"), F.col("b"), F.lit(0.7))).collect()
    assert [r[0] for r in f] == [1.0, 1.0, None, 0.7]


def brute_rank(scores, seen, target, n):
    order = sorted((i for i in range(n) if i not in seen), key=lambda i: (-scores.get(i, 0.0), i)) + sorted(seen)
    return order.index(target) + 1


def test_target_ranks_match_a_full_sort(spark):
    rng = np.random.default_rng(0)
    n, rows, seen, targets, want = 12, [], [], [], {}
    for u in range(40):
        s = {int(i): float(rng.integers(-2, 3)) for i in rng.choice(n, 7, replace=False)}
        own = {int(i) for i in rng.choice(n, 4, replace=False)}
        t = int(rng.integers(0, n))
        rows += [(u, i, v) for i, v in s.items()]
        seen += [(u, i) for i in own]
        targets.append((u, t))
        want[u] = (brute_rank(s, own, t, n), t in own)
    got = evaluate.target_ranks(frame(spark, rows, "user_id int, item_id int, score double"), frame(spark, seen, "user_id int, item_id int"), frame(spark, targets, "user_id int, item_id int"), spark.range(n).select(F.col("id").cast("int").alias("item_id")))
    assert {r.user_id: (r["rank"], r.masked) for r in got.collect()} == want


def test_metrics(spark):
    r = evaluate.per_user(frame(spark, [(1, 1, 3, False), (2, 1, 7, False), (3, 1, 2, True)], "user_id int, item_id int, rank long, masked boolean")).orderBy("user_id").collect()
    assert (r[0].mrr, r[0].map_5, r[0].ndcg_5, r[0].p_5, r[0].r_5) == (1 / 3, 1 / 3, 0.5, 0.2, 1.0)
    assert r[1].r_5 == 0 and r[1].ndcg_10 == pytest.approx(1 / 3) and r[2].r_10 == 0
    b = frame(spark, [(2,), (3,), (7,), (11,), (1,)], "n int").select(evaluate.bucket(F.col("n"))).collect()
    assert [x[0] for x in b] == ["2", "3-4", "5-10", "11+", "11+"]


@pytest.mark.parametrize("pos,neg,stat,p", [(24, 39, 768, 0.0588), (30, 25, 700, 0.5002), (9, 6, 48, 0.4386), (12, 19, 192, 0.2087), (23, 25, 563.5, 0.7728)])
def test_wilcoxon_published_rows(spark, pos, neg, stat, p):
    rows = [(1.0, 0.0)] * pos + [(0.0, 1.0)] * neg + [(1.0, 1.0)] * 50
    r = S.wilcoxon(frame(spark, [("t", *x) for x in rows], "g string, a double, b double"), "g", "a", "b").first()
    assert (r.n_pos, r.n_neg, r.n_zero, r.statistic) == (pos, neg, 50, stat) and round(r.p, 4) == p


def test_wilcoxon_needs_ten(spark):
    assert S.wilcoxon(frame(spark, [("t", 1.0, 0.0)] * 9, "g string, a double, b double"), "g", "a", "b").first().p is None


def test_bootstraps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    df = frame(spark, [("m", i, float(v)) for i, v in enumerate(x)], "g string, k int, v double")
    r = S.bootstrap_ci(df, "g", "v", n_boot=4000, order="k").first()
    se = x.std() / math.sqrt(len(x))
    assert abs(r.lo - (x.mean() - 1.96 * se)) < 0.02 and abs(r.hi - (x.mean() + 1.96 * se)) < 0.02
    q = S.poisson_bootstrap(df, "g", "v", "k").first()
    assert abs(q.lo - r.lo) < 0.06 and abs(q.hi - r.hi) < 0.06


def test_agreement(spark):
    df = frame(spark, [(1, 1, 1), (1, 1, 0), (0, 0, 0), (0, 1, None)], "a int, b int, c int")
    k = S.cohens_kappa(df, "a", "b").first()
    assert (k.n, k.agreement, k.kappa) == (4, 0.75, 0.5)
    assert S.cohens_kappa(frame(spark, [(1, 1)] * 3, "a int, b int"), "a", "b").first().kappa is None
    f = S.fleiss_kappa(df, ["a", "b", "c"]).first()
    p = np.array([1, 1 / 3, 1]).mean()
    e = (5 / 9) ** 2 + (4 / 9) ** 2
    assert f.n == 3 and f.kappa == round((p - e) / (1 - e), 4)
    u = panel.unanimity(df, ["a", "b", "c"]).first()
    assert (u.n, u.unanimous, u.to_adjudicate) == (3, 2, 1)


def test_gold(spark):
    df = frame(spark, [(1, 1, 0, None), (1, 0, None, None), (1, None, None, None), (1, 1, 1, 0)], "annotator_1 int, annotator_2 int, annotator_3 int, adj int")
    got = [r[0] for r in df.select(panel.gold(["annotator_1", "annotator_2", "annotator_3"], "adj")).collect()]
    assert got == [1, None, None, 0]
    assert panel.rater_columns(["annotator_10", "x", "annotator_2", "annotator_x"]) == ["annotator_2", "annotator_10"]


def test_strata_and_weights(spark):
    rows = [(i, j, round(1 / (i + j), 4)) for i in range(1, 9) for j in range(i + 1, 9)]
    p = frame(spark, rows, "a int, b int, jaccard double").withColumn("merge", F.col("jaccard") > 0.3)
    s = panel.strata(p, "merge", seq=None, top=3)
    pool = {r.stratum: r.pool_size for r in panel.pools(s, 100).collect()}
    assert sum(pool.values()) == 4950 and pool["merge"] == 1 and pool["top"] == 3
    sm = panel.sample_strata(s, {"top": 2, "hard": 5, "random": 5}).collect()
    assert len({r.pair_id for r in sm}) == len(sm) and sum(r.stratum == "random" for r in sm) == 5
    w = {r.stratum: r.weight for r in panel.stratum_weights(spark.createDataFrame(sm), panel.pools(s, 100)).collect()}
    assert w["merge"] == 1.0 and w["random"] == pool["random"] / 5


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    a = panel.sample(df, 50, "k").collect()
    assert a == panel.sample(df.repartition(9), 50, "k").collect() and len(set(a)) == 50
    assert panel.sample(df, 50, "k", seed=1).collect() != a


def test_criteria(spark):
    rec = frame(spark, [("R1", "interaction", "u1", "h1", 8.0, "2020-01-01", None), ("R2", "interaction", "u1", "h1", 8.0, "2021-01-01", None), ("R3", "hotel", None, "h1", None, None, "Sun Hotel"), ("R4", "hotel", None, "h9", None, None, "Hotel")], "record_id string, record_type string, user_id string, hotel_id string, rating double, date string, name string")
    inter = frame(spark, [("u1", "h1", 8.0, "2020-01-01")], "user_id string, hotel_id string, rating double, date string")
    known = frame(spark, [("u1", "Nam")], "user_id string, CustomerName string")
    got = {r.record_id: (r.c1, r.c2, r.c3) for r in panel.record_criteria(rec, inter, known).collect()}
    assert got == {"R1": (1, 1, 1), "R2": (1, 0, 1), "R3": (1, 1, 1), "R4": (1, 0, 0)}
    assert {r.record_id: r.c3 for r in panel.record_criteria(rec, inter, None).collect()}["R1"] == 0


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        identity.policy(F.lit("x"), F.lit(False), "nope")
    with pytest.raises(ValueError):
        panel.study_rows(spark.range(1), "nope")


def test_collisions(spark):
    rows = [("An", "2020-01-01", "hue"), ("An", "2020-01-01", "hanoi"), ("An", "2020-01-02", "hue"), ("Bo", "2020-01-01", "hue")]
    df = frame(spark, rows, "CustomerName string, d string, loc_key string").withColumn("Date_parsed", F.col("d").cast("date"))
    r = identity.collision_bound(df).first()
    assert (r.n_names, r.n_colliding, r.people, r.colliding_interactions) == (2, 1, 3, 3)


def test_sequences(spark):
    df = frame(spark, [(1, i, i) for i in range(1, 6)], "user_id int, item_id int, ts int")
    p = sequences.prefixes(df, ["ts"], 2).orderBy("next").collect()
    assert [(r.prefix, r.next) for r in p] == [([1], 2), ([1, 2], 3), ([2, 3], 4), ([3, 4], 5)]
    h = sequences.histories(df, ["ts"]).select(sequences.padded(F.col("items"), 3).alias("a"), sequences.padded(F.col("items"), 7).alias("b")).first()
    assert h.a == [3, 4, 5] and h.b == [0, 0, 1, 2, 3, 4, 5]
    n = sequences.negatives(df, df, df.select("user_id", "item_id"), 3)
    assert n.count() == 0
    assert sequences.negatives(df, df, None, 2).count() == 10


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 8))
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = rankers.cosine_top(df, "k", "v", 3, F.col("k") % 100 == 0).toPandas()
    for q, own in got.groupby("a"):
        s = np.round(u @ u[q], 6)
        s[q] = -2
        assert own.sort_values("rank").b.tolist() == np.lexsort((np.arange(len(s)), -s))[:3].tolist()


def test_trained_factors_rank_better_than_chance(spark):
    rows = [(u, i) for u in range(40) for i in range(20) if (u % 2) == (i % 2) and (u + i) % 3]
    df = frame(spark, rows, "user_id long, item_id long")
    s = rankers.factor_scores(rankers.bpr(df, epochs=60, batch=256)).toPandas()
    same = (s.user_id % 2) == (s.item_id % 2)
    assert s[same].score.mean() > s[~same].score.mean() + 0.5
    g = rankers.factor_scores(rankers.lightgcn(df, dim=8, epochs=30, batch=256)).toPandas()
    same = (g.user_id % 2) == (g.item_id % 2)
    assert g[same].score.mean() > g[~same].score.mean() + 0.5
    with pytest.raises(ValueError):
        rankers.lightgcn(df, max_pairs=1)
    f = rankers.item_factors(df, 4).toPandas()
    assert len(f) == 20 and len(f.factors[0]) == 4


def plain_lightgcn(pairs, dim, layers, lr, reg, epochs, batch, seed):
    """The same training with every propagation written out: all layers of all nodes, forwards and backwards."""
    u, i = np.array(sorted(pairs)).T
    users, u = np.unique(u, return_inverse=True)
    items, i = np.unique(i, return_inverse=True)
    a = np.zeros((len(users) + len(items),) * 2)
    a[u, i + len(users)] = a[i + len(users), u] = 1
    a /= np.sqrt(np.outer(a.sum(0), a.sum(0)))
    p = sum(np.linalg.matrix_power(a, k) for k in range(layers + 1)) / (layers + 1)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (len(p), dim))
    m, v = np.zeros_like(e), np.zeros_like(e)
    for step in range(1, epochs * -(-len(u) // batch) + 1):
        k = rng.integers(0, len(u), batch)
        x, y, z = u[k], i[k] + len(users), rng.integers(0, len(items), batch) + len(users)
        f, g = p @ e, np.zeros_like(e)
        s = (1 / (1 + np.exp((f[x] * (f[y] - f[z])).sum(1))))[:, None] / batch
        np.add.at(g, x, -s * (f[y] - f[z]))
        np.add.at(g, y, -s * f[x])
        np.add.at(g, z, s * f[x])
        g = p @ g + reg * e / len(e)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        e = e - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {**{("user", int(k)): r for k, r in zip(users, p @ e)}, **{("item", int(k)): r for k, r in zip(items, (p @ e)[len(users):])}}


def test_lightgcn_equals_plain_propagation_and_trains_once(spark):
    rng = np.random.default_rng(5)
    settings = {"dim": 4, "lr": 0.05, "reg": 1e-2, "epochs": 2, "batch": 32, "seed": 7}
    for n_items, n, layers in ((12, 200, 3), (90, 160, 3), (90, 160, 2), (12, 200, 1)):  # a dense graph and a thin one
        rows = sorted({(int(u) * 3, int(i) + 100) for u, i in zip(rng.integers(0, 30, n), rng.integers(0, n_items, n))})
        model = rankers.lightgcn(frame(spark, rows, "user_id long, item_id long"), layers=layers, **settings)
        want = plain_lightgcn(rows, layers=layers, **settings)
        got = {(r.kind, r.id): r.factors for r in model.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    plan = rankers.factor_scores(model)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan.split("InMemoryRelation")[0]  # users and items are read from one model


def test_lightgcn_trains_one_model_in_several_tasks(spark):
    rng = np.random.default_rng(6)
    settings = {"dim": 4, "lr": 0.05, "reg": 1e-2, "epochs": 2, "batch": 32, "seed": 7}
    for n_items, n, layers in ((12, 200, 3), (90, 160, 3), (90, 160, 2), (12, 200, 1)):  # a dense graph and a thin one
        rows = sorted({(int(u) * 3, int(i) + 100) for u, i in zip(rng.integers(0, 30, n), rng.integers(0, n_items, n))})
        model = rankers.lightgcn(frame(spark, rows, "user_id long, item_id long"), layers=layers, max_pairs=60, task_pairs=20, **settings)  # more pairs than one task may hold
        want = plain_lightgcn(rows, layers=layers, **settings)
        got = {(r.kind, r.id): r.factors for r in model.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    # two users for four tasks and batches without a task's pair; nulls are the last nodes, ids beyond a double's digits stay apart
    rows = [(1, 2**60), (1, 2**60 + 1), (9, 2**60)]
    settings["batch"] = 1
    model = rankers.lightgcn(frame(spark, [*rows, (None, 2**60 + 1), (9, None)], "user_id long, item_id long"), task_pairs=1, **settings)
    last = 2**62
    want = plain_lightgcn([*rows, (last, 2**60 + 1), (9, last)], layers=3, **settings)
    got = {(r.kind, last if r.id is None else r.id): r.factors for r in model.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert rankers.lightgcn(frame(spark, [(None, 1), (None, 2)], "user_id long, item_id long"), task_pairs=1, **settings).count() == 3
    assert rankers.lightgcn(frame(spark, [], "user_id long, item_id long")).collect() == []


def test_user_neighbours_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = {(int(u) * 2, int(i)) for u, i in zip(rng.integers(0, 60, 420), rng.integers(0, 15, 420))}
    rows |= {(200 + u, i) for u in range(20) for i in (1, 2, 3 + u % 2)}  # users alike, so that cosines tie
    rows |= {(300, 99), (301, None), (2, None), (None, 3)}  # an item of its own, null items, a null user
    own = {}
    for u, i in rows:
        own.setdefault(u, set()).add(i)
    own.pop(None)
    want = {}
    for u, x in own.items():
        sim = {v: len((x & y) - {None}) / (len(x) * len(y)) ** 0.5 for v, y in own.items() if v != u and (x & y) - {None}}
        for v in sorted(sim, key=lambda v: (-round(sim[v], 12), v))[:7]:
            for i in own[v]:
                if i is None or i not in x:
                    want[u, i] = want.get((u, i), 0) + sim[v]
    df = frame(spark, list(rows), "user_id long, item_id int")
    for options in ({}, {"block": 7, "part_pairs": 60}):
        near = rankers.userknn_neighbours(df, 7, **options)
        got = {(r.user_id, r.item_id): r.score for r in near.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    # no pair of users is joined on an item and dealt
    assert "item_id#" not in "".join(x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    short = rankers._Sets([1, 2], [2, 2], [2, 2], [5, 6, 5, 7])
    many = rankers._Sets(np.arange(10, 60), np.full(50, 2), np.full(50, 2), np.tile([5, 6], 50))
    row, who, sim = rankers._nearest(short, many, 3, width=8, step=1)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and who.tolist() == [10, 11, 12] * 2 and np.allclose(sim, [1] * 3 + [0.5] * 3)


def test_item_texts(spark):
    items = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "item_id int, k string")
    content = frame(spark, [("a", "x", None), ("b", None, " ")], "k string, p string, q string")
    assert {r.item_id: r.text for r in rankers.item_texts(items, content, "k", ["p", "q"]).collect()} == {1: "x", 2: "item 2", 3: "item 3"}


def test_histogram_edges(spark):
    df = frame(spark, [(1.0,), (1.49,), (1.5,), (10.0,), (0.5,), (None,)], "v double")
    assert {r.bin: r.n for r in split.histogram(df, "v", 1.0, 10.0, 0.5).collect()} == {0: 2, 1: 1, 17: 1}


def test_over_seeds(spark):
    cols = {c: [0.1, 0.3] for c in ["mrr", *[f"{m}_{k}" for k in (5, 10) for m in ("map", "ndcg", "p", "r")]]}
    r = evaluate.over_seeds(spark.createDataFrame(pd.DataFrame({"method": ["m", "m"], **cols})), "method").first()
    assert r.mrr == 0.2 and r.mrr_sd == 0.1


def test_factors_trained_in_blocks(spark):
    """Several blocks with averaged copies, one heavy user cut among them: rerun alike, better than chance on pairs left out."""
    rows = [(u, i) for u in range(60) for i in range(30) if (u % 2) == (i % 2) and (u + i) % 5] + [(100, i) for i in range(0, 30, 2)]
    df = frame(spark, rows, "user_id long, item_id long")
    model = lambda d: rankers.factor_scores(rankers.bpr(d, epochs=40, block_rows=200, factors=8)).toPandas().sort_values(["user_id", "item_id"], ignore_index=True)
    one = model(df)
    assert one.equals(model(df)) and len(one) == 61 * 30
    held = one[(one.user_id < 60) & ((one.user_id % 2) == (one.item_id % 2)) & ((one.user_id + one.item_id) % 5 == 0)].score.mean()
    other = one[(one.user_id < 60) & ((one.user_id % 2) != (one.item_id % 2))].score.mean()
    assert held > other + 0.3


def test_static_ranks_equal_the_general_ones(spark):
    rng = np.random.default_rng(3)
    seen = frame(spark, sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 20, 150), rng.integers(0, 15, 150))}), "user_id int, item_id int")
    items = frame(spark, [(i,) for i in range(18)], "item_id int")  # three that nobody has
    targets = frame(spark, [(u, int(rng.integers(0, 18))) for u in range(22)], "user_id int, item_id int")  # two users without rows
    pop = rankers.popularity(seen)
    users = targets.select("user_id").distinct()
    want = evaluate.target_ranks(users.crossJoin(pop), seen, targets, items).collect()
    got = evaluate.static_ranks(pop, seen, targets, items).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r.masked for r in got)


def test_one_to_one(spark):
    a, b = frame(spark, [(1, "x"), (2, "y"), (None, "z")], "k int, a string"), frame(spark, [(1, 10), (3, 30)], "k int, b int")
    assert sorted(map(str, quality.one_to_one(a, b, ["k"]).collect())) == sorted(map(str, a.join(b, ["k"], "left").collect()))
    with pytest.raises(Exception, match="key repeats on the right side: 1"):
        quality.one_to_one(a, b.unionByName(b.limit(1)), ["k"]).collect()
    with pytest.raises(Exception, match="key repeats on the left side"):
        quality.one_to_one(a.unionByName(a), b, ["k"]).collect()


def test_ridge_grid_matches_dense_algebra(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((12, 7)) < 0.4).astype(float)
    x[:, 0] = 1
    pairs = frame(spark, [(int(u), int(i)) for u, i in zip(*np.nonzero(x))], "user_id int, item_id int")
    got = rankers.ridge_grid(pairs, (1.0, 10.0), "column").toPandas()
    for lam in (1.0, 10.0):
        p = np.linalg.inv(x.T @ x + lam * np.eye(7))
        w = -p / np.diag(p)[None, :]
        np.fill_diagonal(w, 0)
        for r in got[got.lam == lam].itertuples():
            assert r.score == pytest.approx((x @ w)[r.user_id, r.item_id], abs=1e-9)
    with pytest.raises(ValueError):
        rankers.ridge_grid(pairs, max_items=3)


def test_settings_are_chosen_on_val_and_tested_once(spark):
    val = frame(spark, [(0.0, 1, 5, 20, False), (0.5, 1, 5, 1, False), (1.0, 1, 5, 1, False)], "lam double, user_id int, item_id int, rank long, masked boolean")
    asked = []

    def scores(best):
        asked.append(best.collect())
        return best

    out = evaluate.tuned(val, scores, lambda s: frame(spark, [(1, 7, 2, False)], "user_id int, item_id int, rank long, masked boolean"), "lam").collect()
    assert [r.lam for r in asked[0]] == [0.5] and len(out) == 1 and out[0].lam == 0.5 and out[0].mrr == 0.5  # of equal ones the first
    sweep = frame(spark, [(0.1, "2", 4, 0.5), (0.1, "11+", 1, 0.1), (0.2, "2", 4, 0.5), (0.2, "11+", 1, 0.3)], "lam double, bucket string, n_users long, recall double")
    assert [tuple(r) for r in evaluate.best_settings(sweep, "lam", "2", 1).collect()] == [(0.2, 0.5, 0.46)]


def test_verify_packet_is_blind(spark):
    df = frame(spark, [(f"p{i}", "a", True, "algo_merge") for i in range(5)], "k string, name string, merged boolean, why string")
    packet, key = panel.verify_packet(df, "k", ["name"])
    assert packet.columns == ["verify_id", "name", "answer"] and {r.why for r in key.collect()} == {"algo_merge"}
    assert sorted(r.verify_id for r in packet.collect()) == [f"V{i:04d}" for i in range(5)]
