"""Token counts behind a digest cache.

A text's count is looked up under (tokenizer-version digest, content digest) in
a stored table.  Texts without an entry are encoded once per distinct content,
and their counts are appended to the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import path_exists, text_or_empty

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
#: Texts are handed to the library in groups of about so many characters.
CHARS_AT_ONCE = 1 << 20


def tokenizer_version(model_path: str) -> str:
    """Digest of everything that a count depends on: the vocabulary file's bytes
    and the library with its version."""
    name = Path(model_path).name
    if name.endswith(".model"):
        import sentencepiece as lib
    elif name.endswith(".json"):
        import tokenizers as lib
    else:
        raise ValueError(f"unknown kind of vocabulary file: {name}")
    h = hashlib.sha256(Path(model_path).read_bytes())
    h.update(f"\0{lib.__name__}\0{lib.__version__}\0plain".encode())
    return h.hexdigest()


def load_counter(model_path: str):
    """A function from a list of texts to their token counts, without begin, end
    or added special tokens, truncation or padding."""
    if model_path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(model_path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


_COUNTERS: dict = {}


def _encode(model_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = _COUNTERS.get(model_path)
    if count is None:
        count = _COUNTERS[model_path] = load_counter(model_path)
    for batch in batches:
        n: list[int] = []
        group: list[str] = []
        size = 0
        for text in batch.column("text"):
            s = text.as_py()
            group.append(s)
            size += len(s)
            if size >= CHARS_AT_ONCE:
                n += count(group)
                group, size = [], 0
        if group:
            n += count(group)
        yield pa.RecordBatch.from_arrays(
            [batch.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"]
        )


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Entries of one tokenizer version; entries that two writers appended at
    the same time are one."""
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    return (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache_path)
        .filter(F.col("tokenizer") == version)
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )


def token_counts(docs: DataFrame, model_path: str, cache_path: str, text: str = "text", key: str = "doc_id", others: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` -> one row per input row: ``key``, ``n_bytes``, ``n_tokens`` and
    the columns ``others``.

    * Normalised content: a null text is the empty text; nothing else is
      changed, since white space, case and Unicode form change a count.
    * ``cache_path`` holds the cache as Parquet; it is made when absent.  Misses
      are encoded once per distinct content (whole texts, however long) and
      appended in one committed write, so an executor lost meanwhile leaves the
      cache as it was.
    * Repeated rows and keys stay repeated; a null key stays null; an empty
      table gives an empty result; other columns are not looked at.
    * Texts cross the network once, already reduced to distinct contents per
      task; the join back to the rows carries 32-byte digests, and a content
      that very many rows share is split by adaptive execution.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), F.struct(F.lit(0), *others).alias("others")).withColumn(
        "content", F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    )
    cached = read_cache(spark, cache_path, version)
    fresh = not path_exists(spark, cache_path)
    misses = rows.select("content", "text")
    if not fresh:
        misses = misses.join(cached, "content", "left_anti")
    misses = misses.groupBy("content").agg(F.first("text").alias("text"))
    counted = misses.mapInArrow(
        lambda it, p=model_path: _encode(p, it), "content binary, n_tokens long"
    )
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    return (
        rows.select("key", "content", "others", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(read_cache(spark, cache_path, version), "content", "left")
        .select(F.col("key").alias(key), "n_bytes", "n_tokens", *(F.col(f"others.{c}") for c in others))
    )
