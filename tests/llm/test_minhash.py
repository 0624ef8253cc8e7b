import random
import re

import pytest

from timeloom.llm import minhash as mh


def brute(rows, words, percent=80):
    texts = {}
    for k, t in rows:
        if k is not None:
            texts[k] = t or ""
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    rows = [(k, " ".join(word() for _ in range(r.randrange(1, 60)))) for k in range(0, 120)]
    base = [word() for _ in range(80)]
    for k in range(200, 290):  # a chain of near copies and a crowd below the threshold
        x = list(base)
        for _ in range(r.randrange(0, 9)):
            x[r.randrange(80)] = word()
        rows.append((k, " ".join(x)))
    rows += [(300 + k, rows[3][1]) for k in range(30)] + [(400, ""), (401, None), (402, "One"), (403, "ONE"), (404, "É x"), (405, "é x"), (406, " \t\n"), (407, "a b c"), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("words, small, block, checked", [(2, 16, 512, 64), (5, 16, 512, 64), (2, 2, 8, 3)])
def test_components_equal_brute_force(spark, monkeypatch, words, small, block, checked):
    monkeypatch.setattr(mh, "SMALL", small)
    monkeypatch.setattr(mh, "BLOCK", block)
    monkeypatch.setattr(mh, "CHECKED", checked)
    rows = corpus()
    df = spark.createDataFrame([*rows, (None, "x y z")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as component_id")
    got = mh.near_duplicates(df, shingle_words=words).collect()
    want = brute(rows, words)
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]], r


def test_bounds_and_survivors():
    b = mh.posterior_bounds(0.8)
    assert len(b) == mh.HASHES // mh.BATCH and b == sorted(b) and b[-1] < 100
    import numpy as np

    x = np.zeros((3, mh.HASHES), np.uint32)
    y = x.copy()
    y[1, :40] = 1
    y[2] = 1
    keep, agree = mh.survivors(x, y, b)
    assert 0 in keep and 2 not in keep and agree[0] == mh.HASHES


def test_pieces_of_long_texts(monkeypatch):
    text = "one two  three\tfour\x0bfive sixsixsix\n" * 50 + "é"
    whole = mh.word_hashes(text.encode())
    monkeypatch.setattr(mh, "PIECE", 17)
    assert (mh.word_hashes(text.encode()) == whole).all() and len(whole) == 301
    assert len(mh.shingle_set("x" * 100_000, 2)) == 1


def test_empty(spark):
    assert mh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bits", [8, 1 << 26])
def test_the_filter_misses_no_id(spark, monkeypatch, bits):
    monkeypatch.setattr(mh, "FILTER_BITS", bits)
    rows = spark.range(3000).selectExpr("id as doc_id", "'x' as text")
    ids = spark.range(0, 3000, 7)
    got = {r["doc_id"] for r in mh.perhaps_in(rows, "doc_id", mh.filter_of(ids)).collect()}
    assert got >= set(range(0, 3000, 7)) and (bits == 8 or len(got) == 429)
    assert mh.perhaps_in(rows, "doc_id", mh.filter_of(ids.limit(0))).count() == 0
