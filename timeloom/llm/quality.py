"""Quality classifier: nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: The vectors are fitted on so many labelled rows at most, half of them of
#: each label where there are enough; which ones, the hash of the id decides.
MAX_LABELLED = 4000
SHAPES = 3072
WORDS = 1024
TERMS = SHAPES + WORDS
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 12.0
#: So many words without repeats are added to a text for the share of repeats, so
#: that one doubled word doesn't fill a short text's vector.
REPEAT_PRIOR = 16
BLOCK = 256
#: A text is turned into terms in pieces of about so many bytes, cut at white
#: space, so memory is bounded by that and the longest word.
PIECE = 1 << 22


def _classes() -> np.ndarray:
    """Byte -> class: white space, line end, lower, upper, digit, bytes beyond
    ASCII, and each further sign alone."""
    t = np.zeros(256, np.int64)
    t[:33] = 0
    t[10] = 1
    nxt = 6
    for b in range(33, 127):
        c = chr(b)
        if c.islower():
            t[b] = 2
        elif c.isupper():
            t[b] = 3
        elif c.isdigit():
            t[b] = 4
        else:
            t[b] = nxt
            nxt += 1
    t[127:] = 5
    return t


CLASS = _classes()
_RNG = np.random.default_rng(20240607)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def term_counts(text: str) -> np.ndarray:
    """Counts of hashed terms: runs of four byte classes, words, and a word that
    repeats the one before it."""
    out = np.zeros(TERMS)
    data = text.encode("utf-8", "replace")
    at, n, last, before = 0, len(data), None, b""
    while at < n:
        end = min(n, at + PIECE)
        while end < n and data[end] > 32:  # a word stays whole
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        c = CLASS[np.concatenate([np.frombuffer(before, np.uint8), b])].astype(np.uint64)
        before = data[max(0, end - 3) : end]  # for the runs over the border
        if len(c) >= 4:
            g = ((c[:-3] * np.uint64(64) + c[1:-2]) * np.uint64(64) + c[2:-1]) * np.uint64(64) + c[3:]
            out[:SHAPES] += np.bincount((_mix(g) % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES)
        gap = CLASS[b] <= 1
        edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
        starts = edge[::2]
        if len(starts):
            where = np.zeros(len(b), np.int64)
            where[starts[0] :] = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
            w = _mix(np.add.reduceat(np.where(gap, np.uint64(0), BYTE_HASH[b] * POWERS[where & 63]), starts))
            out[SHAPES : TERMS - 1] += np.bincount((w % np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS - 1)
            out[TERMS - 1] += int((w[1:] == w[:-1]).sum()) + (last is not None and w[0] == last)
            last = w[-1]
        at = end
    return out


def term_vector(text: str) -> np.ndarray:
    """Square roots of the shares of the terms, shapes and words each of length
    one half, the share of repeated words beside them."""
    n = term_counts(text)
    shapes, words = n[:SHAPES].sum(), n[SHAPES : TERMS - 1].sum()
    out = np.zeros(TERMS, np.float32)
    if shapes:
        out[:SHAPES] = np.sqrt(n[:SHAPES] / shapes)
    if words:
        out[SHAPES : TERMS - 1] = 0.5 * np.sqrt(n[SHAPES : TERMS - 1] / words)
        out[TERMS - 1] = np.sqrt(n[TERMS - 1] / (words + REPEAT_PRIOR))
    return out


@dataclass(frozen=True)
class QualityModel:
    """Labelled latent vectors; of bounded size, so it can be broadcast."""

    projection: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str]) -> np.ndarray:
        x = np.stack([term_vector(t) for t in texts]).astype(np.float64) @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 among the ``NEIGHBOURS`` nearest labelled vectors and
        those as near as the last of them, each with the weight
        exp(SHARPNESS * (cosine - 1)); the prior for a text without terms."""
        out = np.full(len(texts), self.prior)
        at = [k for k, t in enumerate(texts) if t.strip()]
        if not at or not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(at), BLOCK):
            rows = at[i : i + BLOCK]
            cosine = self.latent([texts[r] for r in rows]) @ self.vectors.T  # in double precision
            row, near = np.nonzero(cosine >= np.partition(cosine, -k, axis=1)[:, -k:].min(1)[:, None])
            weight = np.exp(SHARPNESS * (cosine[row, near] - 1))
            out[rows] = np.bincount(row, weight * self.labels[near], len(rows)) / np.bincount(row, weight, len(rows))
        return np.clip(out, 0.0, 1.0)


def fit_model(texts: list[str], labels: list[int]) -> QualityModel:
    """The model of labelled texts at hand."""
    keep = {k: t for k, t in enumerate(texts) if t.strip()}
    return _fit(np.stack([term_vector(t) for t in keep.values()]) if keep else np.zeros((0, TERMS), np.float32), [labels[k] for k in keep], labels)


def _fit(x: np.ndarray, y: list[int], every: list[int], seed: int = 7) -> QualityModel:
    """Truncated SVD (randomised subspace iteration) of the labelled rows' terms."""
    prior = float(np.mean(every)) if len(every) else 0.5
    if not len(x):
        return QualityModel(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    dims = min(DIMENSIONS, len(x))
    q = np.random.default_rng(seed).standard_normal((TERMS, min(dims + 16, len(x)))).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x @ q)[0]
        q = np.linalg.qr(x.T @ q)[0]
    vt = np.linalg.svd(x @ q, full_matrices=False)[2]
    projection = (q @ vt[:dims].T).astype(np.float64)
    v = x @ projection
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return QualityModel(projection, v, np.asarray(y, np.float64), prior)


def held_out(key):
    """Rows that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most ``max_labelled`` rows of ``labels`` (doc_id, quality) that
    aren't held out: the ones with the smallest hashes of their ids, half of each
    label, so the model's size doesn't grow with the tables.  Ids or labels that
    are null, other labels than 0 and 1, and documents without text take no part;
    without any row left, every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    half = max_labelled // 2
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(*order).limit(half)
        picked = part if picked is None else picked.union(part)
    # bounded by max_labelled, whatever the size of the tables
    chosen = {r["doc_id"]: r["quality"] for r in picked.collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(ids), "doc_id", "left_semi")
        .mapInArrow(_vectors, "doc_id long, v binary")
    )
    found = {r["doc_id"]: r["v"] for r in rows.toLocalIterator()}
    order_ids = sorted(found)
    x = np.zeros((len(order_ids), TERMS), np.float32)
    for row, k in enumerate(order_ids):
        n = len(found[k]) // 6
        x[row, np.frombuffer(found[k], np.uint16, n)] = np.frombuffer(found[k], np.float32, n, 2 * n)
    return _fit(x, [chosen[k] for k in order_ids], list(chosen.values()))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms as sparse pairs: an index of two bytes and a weight of four each."""
    for batch in slices(batches):
        ids, out = [], []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            s = text.as_py()
            if s.strip():
                v = term_vector(s)
                at = np.flatnonzero(v)
                ids.append(key)
                out.append(at.astype(np.uint16).tobytes() + v[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "v"])


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in slices(batches):
        scores = m.scores(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Exact cosines of each document with all labelled vectors, in blocks.  A
    null, empty or blank text scores the prior of the fitted labels (each label
    weighs by its fitted share); repeated rows score alike and stay repeated; a
    null id has a null held_out.  The text alone is looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(
        lambda it, m=sent: _score(m, it), "doc_id long, score double"
    )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _keep(model, column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in slices(batches):
        texts = ["" if t is None else t for t in batch.column(column).to_pylist()]
        yield batch.filter(pa.array(m.scores(texts) >= 0.5))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it, m=sent, k=docs.columns.index("text"): _keep(m, k, it), docs.schema)
