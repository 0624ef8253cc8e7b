import math

import pytest
from pyspark.sql import functions as F

from timeloom.llm import mixing as mx


def test_exponents():
    t = {"a": 900, "b": 90, "c": 10}
    w = mx.weights_at(t, 1.0)
    assert w == pytest.approx({"a": 0.9, "b": 0.09, "c": 0.01}) and mx.weights_at(t, 0.0)["c"] == pytest.approx(1 / 3)
    m = mx.solve(t, target_entropy=0.8, budget=1000)
    assert mx.entropy(m.weights) == pytest.approx(0.8, abs=1e-6)
    m = mx.solve(t, max_repetition=3.0, budget=1000)
    assert max(m.quotas[s] / t[s] for s in t) == pytest.approx(3.0, abs=0.11) and m.exponent > 0
    m = mx.solve(t, max_repetition=2.0)
    assert all(q >= t[s] for s, q in m.quotas.items()) and max(m.quotas[s] / t[s] for s in t) <= 2.0 + 0.1
    assert mx.solve({}).quotas == {} and mx.solve({"a": 0}).quotas == {}
    assert mx.solve(t, target_entropy=math.log(3) + 1, budget=9).exponent == 0.0


def docs(spark, n=600):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))


@pytest.mark.parametrize("budget", [None, 700, 5000])
def test_copies_realise_the_quotas(spark, monkeypatch, budget):
    monkeypatch.setattr(mx, "BLOCK_TOKENS", 40)
    d = docs(spark)
    got = mx.copies(d, max_repetition=None, target_entropy=1.2, budget=budget).collect()
    assert len(got) == 600
    sizes, used, most = {}, {}, {}
    for r in got:
        s = r["source"] or ""
        sizes[s] = sizes.get(s, 0) + r["n_tokens"]
        used[s] = used.get(s, 0) + r["n_tokens"] * r["n_copies"]
        most.setdefault(s, []).append(r["n_copies"])
    mix = mx.solve(sizes, target_entropy=1.2, budget=budget)
    for s, q in mix.quotas.items():
        assert q - 7 < used[s] <= q and max(most[s]) - min(most[s]) <= 1
    again = {r["doc_id"]: r["n_copies"] for r in mx.copies(d.repartition(7), max_repetition=None, target_entropy=1.2, budget=budget).collect()}
    assert again == {r["doc_id"]: r["n_copies"] for r in got}


def test_mix_keeps_every_document(spark):
    d = docs(spark)
    out = mx.mix(d, max_repetition=2.0)
    assert out.columns == d.columns and out.select("doc_id").distinct().count() == 600
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


@pytest.mark.parametrize("budget", [None, 3000])
def test_copies_equal_brute_force(spark, monkeypatch, budget):
    """Each source's documents in the order of the permutation, as far as the rest reaches."""
    monkeypatch.setattr(mx, "BLOCK_TOKENS", 30)
    d = docs(spark).union(spark.createDataFrame([(None, "w w w", "hot"), (9000, "", "hot")], "doc_id long, text string, source string"))
    got = [r.asDict() for r in mx.copies(d, budget=budget).collect()]
    sizes = {}
    for r in got:
        sizes[r["source"] or ""] = sizes.get(r["source"] or "", 0) + r["n_tokens"]
    assert sizes == {(r["source"] or ""): r["n"] for r in d.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).collect()}
    quotas = mx.solve(sizes, max_repetition=2.0, budget=budget).quotas
    assert len({r["block"] for r in got if r["source"] == "hot"}) > 5
    for s, n in sizes.items():
        whole, rest = divmod(quotas[s], n)
        own = sorted((r for r in got if (r["source"] or "") == s), key=lambda r: (r["block_order"], r["block"], r["doc_order"], r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]))
        used, blocks = 0, {}
        for r in own:
            blocks.setdefault(r["block"], []).append(r)
        for rows in blocks.values():
            t = sum(r["n_tokens"] for r in rows)
            fits = used + t <= rest
            run = used
            for r in rows:
                run += r["n_tokens"]
                assert r["n_copies"] == whole + (r["n_tokens"] > 0 and (fits or run <= rest)), r
            used += t


def test_columns_of_any_name(spark):
    d = docs(spark, 30).selectExpr("*", "1 as n", "2 as own", "3 as row", "4 as copy", "5 as __copies", "6 as `a.b`", "7 as n_copies")
    out = mx.mix(d)
    assert out.columns == d.columns and out.distinct().count() == 30
    counted = d.select("doc_id", "source", F.lit(3).cast("long").alias("t"))
    assert mx.mix(d, counted, tokens="t").select("doc_id").distinct().count() == 30


def test_hard_rows(spark):
    d = spark.createDataFrame([(1, None, "a"), (1, "x y", "a"), (None, "z", None), (2, "", "b")], "doc_id long, text string, source string").selectExpr("*", "1 as n_copies", "2 as block")
    got = mx.copies(d).collect()
    assert len(got) == 4 and all(r["n_copies"] >= 1 for r in got)
    assert mx.mix(d).count() >= 4 and mx.copies(d.limit(0)).count() == 0
