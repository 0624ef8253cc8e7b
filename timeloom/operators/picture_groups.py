"""Equal and similar pictures: decisions on pairs, classes, adjacent groups.

A picture is the columns ``width``, ``height``, ``stride`` and ``pixels``; what a
row holds beyond its width is padding and never counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import pixels as px
from .grouping import GROUPS, exact_runs
from .timeline import KEY

PICTURE = ["width", "height", "stride", "pixels"]


def visible_digest(width: Column, height: Column, stride: Column, pixels: Column) -> Column:
    """SHA-256 of the size and the visible bytes; null for a buffer that isn't the
    picture it says it is."""
    whole = (width > 0) & (height > 0) & (stride >= 4 * width) & (F.octet_length(pixels) == stride * height)
    rows = F.aggregate(
        F.sequence(F.lit(0), height - 1), F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":")).cast("binary"),
        lambda done, y: F.concat(done, F.substring(pixels, y * stride + 1, 4 * width)),
    )
    return F.when(whole, F.sha2(rows, 256))


def with_digest(pictures: DataFrame) -> DataFrame:
    return pictures.withColumn("digest", visible_digest(*map(F.col, PICTURE)))


def picture_runs(frames: DataFrame) -> DataFrame:
    """Maximal runs of equal pictures.  Digests are made before the shuffle, so
    no pixels move."""
    return exact_runs(with_digest(frames).select(KEY, "frame_id", "digest"), "digest")


def equal_classes(pictures: DataFrame, key: str) -> DataFrame:
    """Per picture the smallest ``key`` of a picture equal to it and how many are
    equal; counted per task before the shuffle, so a picture that very many rows
    share is one row of it.  Buffers that are no pictures equal nothing."""
    rows = with_digest(pictures).select(key, "digest").filter("digest is not null")
    classes = rows.groupBy("digest").agg(F.min(key).alias("class_id"), F.count("*").alias("equals"))
    return rows.join(classes, "digest").select(key, "class_id", "equals")


Compare = Callable[[np.ndarray, int, np.ndarray, int], int | None]


def hybrid_compare(max_distance: int, least: int) -> Compare:
    """Likeness of two pictures with their gate hashes, None for a rejection; too
    far a hash rejects before pixels are compared."""

    def compare(a: np.ndarray, ha: int, b: np.ndarray, hb: int) -> int | None:
        if a.shape != b.shape:
            raise px.PictureError("sizes differ")
        if hash_distance(ha, hb) > max_distance:
            return None
        s = px.rgb_similarity(a, b)
        return s if s >= least else None

    return compare


def luma_compare(least: int) -> Compare:
    def compare(a: np.ndarray, ha: int, b: np.ndarray, hb: int) -> int | None:
        s = px.luma_similarity(a, b)
        return s if s >= least else None

    return compare


def hash_distance(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


def _fold(compare: Compare, gate: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted frames go by once; two pictures of the open group are the state."""
    names = [KEY, "ordinal", "first", "last", "frames", "floor"]
    types = [pa.int64()] * 5 + [pa.int32()]
    src, ordinal, first, last, low, rep, prev = None, 0, 0, 0, px.SCALE, None, None

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        done = []
        keys, ids = batch.column(KEY).to_pylist(), batch.column("frame_id").to_pylist()
        sizes = [batch.column(c).to_pylist() for c in ("width", "height", "stride")]
        for i, (s, f) in enumerate(zip(keys, ids)):
            img = px.picture(batch.column("pixels")[i].as_py(), *(c[i] for c in sizes))
            now = (img, px.gate_hash(img) if gate else 0)
            if s == src:
                if f != last + 1:
                    raise ValueError(f"source {s}: frame {f} after {last}")
                if compare(*prev, *now) is not None and (to_rep := compare(*rep, *now)) is not None:
                    last, prev, low = f, now, min(low, to_rep)
                    continue
            if src is not None:
                done.append((src, ordinal, first, last, last - first + 1, low))
            ordinal = ordinal + 1 if s == src else 0
            src, first, last, low, rep, prev = s, f, f, px.SCALE, now, now
        if done:
            yield emit(done)
    if src is not None:
        yield emit([(src, ordinal, first, last, last - first + 1, low)])


def picture_groups(frames: DataFrame, compare: Compare, gate: bool) -> DataFrame:
    """A frame joins the open group if ``compare`` accepts it against the frame
    before and then against the group's first; the floor is the lowest likeness to
    the first.  Ids of a source are contiguous and sizes equal, or the job fails.

    The order matters within a source, so a source streams through one task with
    two pictures in memory; sources are dealt over the tasks.
    """
    rows = frames.select(KEY, "frame_id", *PICTURE).repartition(KEY).sortWithinPartitions(KEY, "frame_id")
    return rows.mapInArrow(lambda it, c=compare, g=gate: _fold(c, g, it), GROUPS)


def hybrid_picture_groups(frames: DataFrame, max_distance: int = 8, least: int = 9700) -> DataFrame:
    checks.similarity_policy(max_distance, least)
    return picture_groups(frames, hybrid_compare(max_distance, least), True)


def luma_picture_groups(frames: DataFrame, least: int = 9700) -> DataFrame:
    checks.similarity_policy(least=least)
    return picture_groups(frames, luma_compare(least), False)


def _decide(max_distance: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = (px.picture(p["pixels"], p["width"], p["height"], p["stride"]) for p in pair)
            if a.shape != b.shape:
                out.append((None, None, "sizes differ", False))
                continue
            d, s = hash_distance(px.gate_hash(a), px.gate_hash(b)), px.rgb_similarity(a, b)
            word = "hash rejected" if d > max_distance else "accepted" if s >= least else "pixels rejected"
            out.append((d, s, word, d > max_distance and s >= least))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "distance", "similarity", "decision", "gate_lost"]
        )


def hybrid_analysis(pairs: DataFrame, max_distance: int = 8, least: int = 9700) -> DataFrame:
    """``id`` of each pair of pictures ``a`` and ``b`` (structs) with the distance
    of their gate hashes, the likeness of their pixels, the decision of gate and
    pixels, and whether the gate alone rejected what the pixels would accept."""
    checks.similarity_policy(max_distance, least)
    return pairs.select("id", "a", "b").mapInArrow(
        lambda it, d=max_distance, n=least: _decide(d, n, it), "id long, distance long, similarity long, decision string, gate_lost boolean"
    )


def _gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w, h, s, p = (batch.column(c).to_pylist() for c in PICTURE)
        hashes = [px.gate_hash(px.picture(*x)) for x in zip(p, w, h, s)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hashes, pa.int64())], ["id", "gate_hash"])


def gate_hashes(pictures: DataFrame, key: str) -> DataFrame:
    """The nearest-sample 9 x 8 difference hash of each picture."""
    return pictures.select(F.col(key).cast("long").alias("id"), *PICTURE).mapInArrow(_gate, "id long, gate_hash long").withColumnRenamed("id", key)
