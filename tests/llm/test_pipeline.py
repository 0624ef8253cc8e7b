import re

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as cp

from timeloom.llm import secrets
from timeloom.llm.common import components, materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
            out = materialise(out, "t")
        seen[name], docs = out, out
    good = {r["doc_id"] for r in seen["quality"].collect()}
    assert all(k in good for k, v in labels.items() if v == 1) and not any(k in good for k, v in labels.items() if v == 0)
    kept = {r["doc_id"] for r in seen["near_dedup"].collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = {k: shingles(texts[k]) for k in good}
    up = {k: k for k in good}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(good)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert kept == {k for k in good if root(k) == k}
    clean = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert clean.keys() == kept and not any(secrets.base_spans(r["text"]) for r in clean.values())
    assert all(r["text"] == secrets.redact(texts[k]) and r["n_chars"] == len(r["text"]) for k, r in clean.items())
    assert {r["doc_id"] for r in seen["mixing"].collect()} == kept
    last = seen["sentencepiece"].collect()
    assert len(last) == seen["mixing"].count() and all(r["round_trip"] for r in last)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (300, 200), (250, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 300: 200, 250: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
