"""Identities and digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
# Fixed value.
#: Tags of this prefix come from samples of a source, not from all of it.
SAMPLED_TAG = "blake3-sample-v1:"


def _framed(c: Column) -> Column:
    """Presence, length and value: no two lists of fields give one text."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), F.length(c), F.lit(":"), c))


def stable_key(*fields: Column) -> Column:
    """A hex key of optional text fields."""
    return F.sha2(F.concat(F.lit("v1"), *map(_framed, fields)), 256)


def content_tag(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def reusable(size: Column, tag: Column) -> Column:
    """Whether an identity is safe to reuse an index by: size known, tag of all content."""
    t = F.trim(tag)
    return size.isNotNull() & F.coalesce((t != "") & ~t.startswith(SAMPLED_TAG), F.lit(False))


def fnv1a(values) -> int:
    """FNV-1a over the little-endian bytes of 64-bit numbers."""
    h = FNV_OFFSET
    for v in values:
        for b in int(v).to_bytes(8, "little", signed=True):
            h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_digest(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Digest of each key's values in order, nulls left out, as 16 hex digits.
    The digest is a fold, so a key is one sorted run; rows stream through it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, n = None, FNV_OFFSET, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([f"{h:016x}"]), pa.array([n], pa.int64())], [by, "digest", "n"])
        for b in batches:
            for k, v in zip(b.column(by).to_pylist(), b.column(value).to_pylist()):
                if k != key:
                    if key is not None:
                        yield out()
                    key, h, n = k, FNV_OFFSET, 0
                if v is not None:
                    n += 1
                    for x in v.to_bytes(8, "little", signed=True):
                        h = (h ^ x) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        if key is not None:
            yield out()

    dealt = rows.select(by, order, value).repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInArrow(work, f"{by} long, digest string, n long")
