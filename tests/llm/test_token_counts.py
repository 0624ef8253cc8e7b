import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from timeloom.llm import token_counts as tc
from timeloom.llm.queries import vocabulary

TEXTS = ["Hello world", "Hello world", "", None, "<s> x </s>", "a\nb  c", "漢字 🙂", "x" * 200_000]


@pytest.fixture(params=["piece_bpe_32k.model", "byte_bpe_50k.json"])
def model(request):
    return vocabulary(request.param)


def want(model, text):
    """By the library itself."""
    if model.endswith(".model"):
        return len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text or "", add_bos=False, add_eos=False))
    return len(tokenizers.Tokenizer.from_file(model).encode(text or "", add_special_tokens=False).ids)


def test_counts_and_cache(spark, tmp_path, model):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens long")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(docs, model, cache).collect()}
    assert got == {k: (len((t or "").encode()), want(model, t)) for k, t in enumerate(TEXTS)}
    entries = spark.read.parquet(cache)
    assert entries.count() == len({t or "" for t in TEXTS})
    more = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, "new one"), (None, "")], "doc_id long, text string")
    again = tc.token_counts(more, model, cache).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in again) == sorted([(1, want(model, "Hello world"))] * 2 + [(2, want(model, "new one")), (-1, want(model, ""))])
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1  # hits aren't encoded or appended


def test_stored_counts_are_used_and_versions_are_apart(spark, tmp_path):
    cache, model = f"file://{tmp_path}/cache", vocabulary()
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = docs.select(F.lit(tc.tokenizer_version(model)).alias("tokenizer"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"), F.lit(77).cast("long").alias("n_tokens"))
    row.union(row.withColumn("tokenizer", F.lit("other")).withColumn("n_tokens", F.lit(5).cast("long"))).write.parquet(cache)
    assert tc.token_counts(docs, model, cache).first()["n_tokens"] == 77


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tc.token_counts(docs, vocabulary(), f"file://{tmp_path}/c").count() == 0
