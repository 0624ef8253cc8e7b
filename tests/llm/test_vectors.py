import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import covertree as ct
from timeloom.llm import rptree as rp

SCHEMA = "vec_id long, embedding array<float>"


def crowd(n=900, d=16, seed=2):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)).astype(np.float32)
    x[100:300] = x[5] + 0.03 * r.standard_normal((200, d)).astype(np.float32)
    x[300:340] = x[7] + 0.12 * r.standard_normal((40, d)).astype(np.float32)
    x[400:460] = x[9]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return [*rows, (2000, None), (2001, [0.0] * d), (2002, [float("nan")] * d), (2003, [None] + [1.0] * (d - 1)), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), rows[3], rows[3]]


def brute_links(rows, cosine=0.95):
    ok = {k: np.asarray(v, np.float64) for k, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    n, up = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {k: (n[k], root(k), root(k) == k) for k in n}


@pytest.mark.parametrize("leaf, block", [(800, 1024), (60, 64)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(rp, "LEAF", leaf)
    monkeypatch.setattr(rp, "BLOCK", block)
    rows = crowd()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as label")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rp.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert got.keys() == want.keys()
    found, every = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= every and found >= 0.97 * every
    assert all(got[k][0] <= want[k][0] for k in want)
    if leaf == 800:
        assert got == want


def test_spill_keeps_close_pairs_together():
    r = np.random.default_rng(4)
    x = rp._unit(r.standard_normal((4000, 32)))
    y = rp._unit(x + 0.05 * r.standard_normal(x.shape))
    close = (x * y).sum(1) >= 0.95
    spill = rp.spill_of(0.95, 32)
    together = np.zeros(len(x), bool)
    for t in range(rp.TREES):
        tree = rp.grow(x, 100, spill, np.random.default_rng(t))
        a, b = ({}, {})
        for side, z in ((a, x), (b, y)):
            for leaf, rows in rp.leaves_of(tree, z, spill):
                for k in rows:
                    side.setdefault(k, set()).add(leaf)
        together |= np.array([bool(a[k] & b[k]) for k in range(len(x))])
    assert close.sum() > 1000 and together[close].mean() > 0.98


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rp.near_duplicates(df).count() == 0 and ct.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def brute_top(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all():
            ok[i] = np.floor(256 * np.asarray(v, np.float64))
    out = []
    for q in ok:
        if q % every == 0:
            s = sorted((-int(ok[q] @ x), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("data, query, leaf", [(8192, 4096, 128), (100, 5, 8)])
def test_top_k_equals_brute_force(spark, monkeypatch, data, query, leaf):
    monkeypatch.setattr(ct, "DATA_BLOCK", data)
    monkeypatch.setattr(ct, "QUERY_BLOCK", query)
    rows = crowd()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as v")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ct.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)


def test_scores_beyond_doubles_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(v) for v in r.integers(-(2**27), 2**27, 4)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ct.top_k(df, F.col("vec_id") % 50 == 0, scale=8.0).select("query_id", "rank", "vec_id", "score").collect()))
    whole = {k: [8 * int(c) for c in v] for k, v in rows}
    want = []
    for q in (0, 50, 100):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:5]
        want += [(q, i + 1, k, -v) for i, (v, k) in enumerate(s)]
    assert got == sorted(want)


def test_rows_of_any_kind_keep_their_place(spark):
    big, small = 1e200, 1e-200
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [big, 0.0]), (3, [0.0, small]), (4, [0.0, big]), (5, [-1.0, 0.5]), (1, [0.0, 1.0]), (6, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in rp.near_duplicates(df).collect())
    # 1 has two vectors: one with 2, one with 3 and 4, and so all are one component
    assert got == [(0, 0, 0, None)] + [(1, 3, 1, True)] * 3 + [(2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (6, 0, 6, True)]


def test_recall_with_many_leaves(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((3000, 64))
    x[1500:] = x[:1500] + 0.25 * r.standard_normal((1500, 64)) * r.random((1500, 1))  # cosines on both sides of 0.95
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in rp.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.95).sum(1) - 1
    assert sum(want) > 1000 and all(got[k] <= want[k] for k in range(3000)) and sum(got.values()) >= 0.97 * want.sum()


def test_cover_tree_invariants():
    x = np.random.default_rng(1).standard_normal((3000, 3))
    seen = []

    def walk(n):
        d = np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1))
        assert d.max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows) and len(n.children) <= ct.FAN_OUT + 1
            for c in n.children:
                walk(c)
        else:
            seen.append(n.rows)

    walk(ct.cover_tree(x, leaf=20))
    assert sorted(np.concatenate(seen)) == list(range(3000))


def test_dual_search_prunes():
    r = np.random.default_rng(8)
    centres = r.standard_normal((30, 4)) * 100
    x = np.floor(np.repeat(centres, 100, 0) + r.standard_normal((3000, 4)))
    q = x[::50]
    work = ct.Work()
    rows, ids, scores = ct.dual_search(q, np.arange(0, 3000, 50), x, np.arange(3000), 5, work)
    assert work.every == 60 * 3000 and work.computed < 0.25 * work.every
    want = []
    for k, v in enumerate(q):
        s = sorted((-(v @ x[i]), i) for i in range(3000) if i != 50 * k)[:5]
        want += [(k, i, -v) for v, i in s]
    assert sorted(zip(rows.tolist(), ids.tolist(), scores.tolist())) == sorted(want)


def test_dual_search_ties_over_blocks(monkeypatch):
    monkeypatch.setattr(ct, "TOGETHER", 7)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (400, 3)).astype(float)
    x[100:250] = x[100]
    ids = rng.permutation(400).astype(np.int64)
    ids[:3] = ids[3]  # one id with several vectors
    q, q_ids = x[::9], ids[::9]
    rows, found, scores = ct.dual_search(q, q_ids, x, ids, 5)
    for i, v in enumerate(q):
        want = sorted((-float(v @ x[j]), int(ids[j])) for j in range(400) if ids[j] != q_ids[i])[:5]
        assert [(-s, j) for s, j in zip(scores[rows == i], found[rows == i])] == want
