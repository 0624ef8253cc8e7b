import zlib

import numpy as np

from timeloom.llm import quality as q
from timeloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in q.score_documents(docs, q.fit_quality(docs, labels)).collect()}
    assert len(got) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [k for k in known if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == known[k] for k in held]) > 0.97


def test_held_out_labels_are_never_used(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", q.F.when(q.held_out(q.F.col("doc_id")), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    a, b = q.fit_quality(docs, labels), q.fit_quality(docs, flipped)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_bound_on_the_labelled_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert len(q.fit_quality(docs, labels, 40).labels) <= 40


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["aa", "BB!!", "c|d", "ee%%"], 12)) for _ in range(60)]
    m = q.fit_model(texts[:40], [k % 2 for k in range(40)])
    z = m.latent(texts[40:])
    for row, got in zip(z, m.scores(texts[40:])):
        cos = m.vectors @ row
        near = np.flatnonzero(cos >= np.sort(cos)[-q.NEIGHBOURS] - 1e-12)
        w = np.exp(q.SHARPNESS * (cos[near] - 1))
        assert abs((w * m.labels[near]).sum() / w.sum() - got) < 1e-6


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "Good words here."), (4, "w " * 200_000)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as quality")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = q.score_documents(docs, q.fit_quality(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in q.score_documents(docs, q.fit_quality(docs, none)).collect()} == {0.5}
    assert q.score_documents(docs.limit(0), q.fit_quality(docs, labels)).count() == 0
    assert q.keep_good(docs, q.fit_quality(docs, none)).count() == 6


def test_terms_do_not_depend_on_the_pieces(monkeypatch):
    text = "Some words, some some words! Été 漢字 été\n\n" * 40 + "x" * 90 + " x x"
    whole = q.term_counts(text)
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(q, "PIECE", size)
        assert (q.term_counts(text) == whole).all()
    data, words = text.encode(), text.split()
    assert whole[: q.SHAPES].sum() == len(data) - 3 and whole[q.SHAPES : q.TERMS - 1].sum() == len(words)
    assert whole[q.TERMS - 1] == sum(a == b for a, b in zip(words, words[1:]))
