"""Similar frames across a whole video: hash keys, candidates, confirmation, top k."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as px

# The least score and the most frames of a report.
MINIMUM, CAP = 9300, 64
KEYS_PER_FRAME = 2 * px.BANDS + 1
# Frames and targets of a block, rows that meet before they are cut into
# blocks, targets' rows scored together, and blocks of targets whose best a task keeps.
FRAMES_AT_ONCE, TARGETS_AT_ONCE, HELD, STRIP, KEPT = 512, 1024, 16384, 128, 8


def describe(frames: DataFrame) -> DataFrame:
    """Pictures (frame_id, width, height, stride, pixels) -> descriptors
    (frame_id, average_hash, difference_hash, rgb)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["frame_id", "average_hash", "difference_hash", "rgb"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            alike = defaultdict(list)  # by size, to be described together
            for f, w, h, s, p in zip(*(b.column(c).to_pylist() for c in ("frame_id", "width", "height", "stride", "pixels"))):
                alike[w, h].append((f, px.picture(p, w, h, s)))
            for (w, h), rows in alike.items():
                at_once = max(1, (1 << 16) // (w * h))
                for k in range(0, len(rows), at_once):
                    ids, imgs = zip(*rows[k : k + at_once])
                    average, difference, small = px.described(np.stack(imgs))
                    cols = (ids, average, difference, [x.tobytes() for x in small])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    out = "frame_id long, average_hash long, difference_hash long, rgb binary"
    return frames.select("frame_id", "width", "height", "stride", "pixels").mapInArrow(work, out)


def describe_luma(grids: DataFrame) -> DataFrame:
    """Grids (frame_id, v: 64 luma values) -> (frame_id, average_hash, difference_hash,
    bucket, luma), the hashes of :mod:`pixels`' column forms; null grids are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = b.column("v").flatten().to_numpy().astype(np.int64).reshape(n, 64)
            total = v.sum(1) + 32
            right = np.zeros((n, 64), bool)
            right[:, :56] = (v.reshape(n, 8, 8)[:, :, :-1] > v.reshape(n, 8, 8)[:, :, 1:]).reshape(n, 56)
            hashes = [np.packbits(x, axis=1, bitorder="little").view(np.int64)[:, 0] for x in (v >= total[:, None] // 64, right)]
            bucket = (total // 64 >> px.BUCKET_SHIFT) * 1057
            cols = [b.column("frame_id"), *map(pa.array, hashes), pa.array(bucket.astype(np.int32)), pa.array([x.tobytes() for x in v.astype(np.uint8)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["frame_id", "average_hash", "difference_hash", "bucket", "luma"])

    return grids.select("frame_id", "v").dropna().mapInArrow(work, "frame_id long, average_hash long, difference_hash long, bucket int, luma binary")


def with_bucket(descriptors: DataFrame) -> DataFrame:
    """Adds the colour bucket."""

    @F.pandas_udf("int")
    def bucket(rgb: pd.Series) -> pd.Series:
        if not len(rgb):
            return pd.Series([], dtype="int32")
        flat = np.frombuffer(b"".join(rgb), np.uint8).reshape(len(rgb), -1, 3).sum(1, dtype=np.int64)
        n = px.SIDE * px.SIDE
        q = np.minimum((flat + n // 2) // n >> px.BUCKET_SHIFT, 31)
        return pd.Series((q[:, 0] | q[:, 1] << 5 | q[:, 2] << 10).astype(np.int32))

    return descriptors.withColumn("bucket", bucket("rgb"))


def keys(descriptors: DataFrame) -> DataFrame:
    """(frame_id, kind, band, value): four bands of each hash, one colour bucket."""
    entries = [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("band"), px.band(F.col(c), k).alias("value")) for kind, c in ((0, "average_hash"), (1, "difference_hash")) for k in range(px.BANDS)]
    entries.append(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("band"), F.col("bucket").alias("value")))
    return descriptors.select("frame_id", F.explode(F.array(*entries)).alias("k")).select("frame_id", "k.kind", "k.band", "k.value")


def incomplete(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("frame_id").agg(F.count("*").alias("n")).filter(F.col("n") != KEYS_PER_FRAME)


def near_keys(targets: DataFrame) -> DataFrame:
    """Keys to look under for each target: its bands, and the 5 x 5 x 5 buckets
    around its colour."""
    own = keys(targets)
    part = lambda s: F.shiftright(F.col("value"), s).bitwiseAND(F.lit(31))
    span = lambda s: F.sequence(F.greatest(part(s) - 2, F.lit(0)), F.least(part(s) + 2, F.lit(31)))
    around = own.filter("kind = 2").select("frame_id", "kind", "band", span(0).alias("r"), span(5).alias("g"), span(10).alias("b"))
    around = around.withColumn("r", F.explode("r")).withColumn("g", F.explode("g")).withColumn("b", F.explode("b"))
    return own.filter("kind < 2").union(around.select("frame_id", "kind", "band", (F.col("r") + F.col("g") * 32 + F.col("b") * 1024).cast("int")))


def candidates(descriptors: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (target, frame_id) that share a key, without the target itself."""
    t = near_keys(targets).withColumnRenamed("frame_id", "target")
    return t.join(keys(descriptors), ["kind", "band", "value"]).filter("target <> frame_id").select("target", "frame_id").distinct()


def confirm(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Adds the likeness of the descriptors, best over small moves and crops.

    Pairs are dealt by the frame, whose partners are as many as there are targets
    that look for it, so a target with very many candidates is spread; a batch
    crops each of its descriptors once."""

    def unpacked(ids: pa.Array, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, first, place = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
        return np.frombuffer(b"".join(raw.take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, px.SIDE, px.SIDE, 3), place

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (x, ix), (y, iy) = unpacked(b.column("target"), b.column("a")), unpacked(b.column("frame_id"), b.column("b"))
                yield pa.RecordBatch.from_arrays([b.column("target"), b.column("frame_id"), pa.array(px.confirm_of(x, ix, y, iy), pa.int64())], ["target", "frame_id", "similarity"])

    spark = descriptors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = pairs.select("target").distinct().join(descriptors.select(F.col("frame_id").alias("target"), F.col("rgb").alias("a")), "target")
    # adaptive execution would join so few bytes into one task, and the work isn't in the bytes
    dealt = pairs.join(asked, "target").repartition(n, "frame_id")
    both = dealt.join(descriptors.select("frame_id", F.col("rgb").alias("b")).repartition(n, "frame_id"), "frame_id")
    return both.select("target", "frame_id", "a", "b").mapInArrow(work, "target long, frame_id long, similarity long")


# Candidates in blocks. Frames near in colour meet by cells of 4 x 4 x 4 buckets, a block
# of frames and one of targets a row, so that no row is made for a pair; pairs that only
# a band brings together are joined one by one.

def blocks(described: DataFrame, data: str, reach: int, size: int) -> DataFrame:
    """Frames (frame_id, bucket, data) -> (cell, ids, buckets, data): each frame in the
    cells that hold a bucket within ``reach`` of its own, ``size`` frames a row."""

    def cut(ids, buckets, raw):
        low, high = ([np.clip((buckets >> s & 31) + d, 0, 31) >> 2 for s in (0, 5, 10)] for d in (-reach, reach))
        cells, rows = [], []
        for way in range(8):
            ends = [way >> c & 1 for c in range(3)]
            at = np.flatnonzero(np.all([~np.bool_(e) | (l != h) for e, l, h in zip(ends, low, high)], axis=0))
            r, g, b = ((h if e else l)[at] for e, l, h in zip(ends, low, high))
            cells.append(r | g << 3 | b << 6)
            rows.append(at)
        cells, rows = np.concatenate(cells), np.concatenate(rows)
        order = np.argsort(cells, kind="stable")
        cells, rows = cells[order], rows[order]
        for part in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
            for k in range(0, len(part), size):
                at = rows[part[k : k + size]]
                one = (cells[part[0]], ids[at].tobytes(), buckets[at].tobytes(), b"".join(raw[x] for x in at))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, (pa.int32(), *[pa.binary()] * 3))], ["cell", "ids", "buckets", "data"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held):
        t = pa.Table.from_batches(held)
        yield from cut(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist())

    rows = described.select("frame_id", "bucket", data).dropna()
    return rows.mapInArrow(work, "cell int, ids binary, buckets binary, data binary")


def met(descriptors: DataFrame, targets: DataFrame, data: str) -> DataFrame:
    """Blocks of targets beside blocks of frames of a cell."""
    # without a number: adaptive execution brings few targets together
    t = blocks(targets.repartition("frame_id"), data, 2, TARGETS_AT_ONCE).toDF("cell", "t_ids", "t_buckets", "t_data")
    f = blocks(descriptors, data, 0, FRAMES_AT_ONCE).toDF("cell", "f_ids", "f_buckets", "f_data")
    # a cell's blocks may all be in one partition, and the work isn't in the bytes
    return t.join(f, "cell").drop("cell").repartition(int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _each(batches: Iterator[pa.RecordBatch]):
    """Of each row: ids and data of targets and frames, and which pairs are candidates."""
    for b in batches:
        for r in range(b.num_rows):
            ti, tb, td, fi, fb, fd = (memoryview(b.column(c)[r].as_buffer()) for c in range(6))
            t, f = np.frombuffer(ti, np.int64), np.frombuffer(fi, np.int64)
            near = px.near_matrix(np.frombuffer(tb, np.int32), np.frombuffer(fb, np.int32))
            near &= t[:, None] != f[None]
            if near.any():
                yield t, np.frombuffer(td, np.uint8).reshape(len(t), -1), f, np.frombuffer(fd, np.uint8).reshape(len(f), -1), near


def _strips(n: int) -> list[slice]:
    return [slice(k, min(k + STRIP, n)) for k in range(0, n, STRIP)]


def by_band(descriptors: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (target, frame_id) that share a band and aren't near in colour."""

    def bands(x: DataFrame) -> DataFrame:
        entries = [F.struct(F.lit(kind * px.BANDS + k).alias("band"), px.band(F.col(c), k).alias("value")) for kind, c in enumerate(("average_hash", "difference_hash")) for k in range(px.BANDS)]
        return x.select("frame_id", "bucket", F.explode(F.array(*entries)).alias("k")).select("frame_id", "bucket", "k.band", "k.value")

    part = lambda c, s: F.shiftright(c, s).bitwiseAND(F.lit(31))
    far = F.lit(False)
    for s in (0, 5, 10):
        far = far | (F.abs(part(F.col("bucket"), s) - part(F.col("other"), s)) > 2)
    t = bands(targets).withColumnsRenamed({"frame_id": "target", "bucket": "other"})
    return t.join(bands(descriptors), ["band", "value"]).filter((F.col("target") != F.col("frame_id")) & far).select("target", "frame_id").distinct()


def luma_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x m scores of grids of 64 luma values."""
    d = px.sums_of_differences(a[:, None], b[:, None])
    return px.basis_points(np.arange(64 * 255 + 1), 64).astype(np.int16)[d]


def luma_pairs(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Adds the score of the grids of each pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(b.num_rows, 64).astype(np.int64) for x in ("a", "b"))
            s = px.basis_points(np.abs(a - c).sum(1), 64)
            yield pa.RecordBatch.from_arrays([b.column("target"), b.column("frame_id"), pa.array(s)], ["target", "frame_id", "similarity"])

    g = descriptors.select("frame_id", "luma")
    both = pairs.join(g.toDF("target", "a"), "target").join(g.toDF("frame_id", "b"), "frame_id")
    return both.select("target", "frame_id", "a", "b").mapInArrow(work, "target long, frame_id long, similarity long")


def luma_near(descriptors: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, frame_id, similarity) of the grids (frame_id, bucket, luma) near in colour."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, td, f, fd, near in _each(batches):
            for rows in _strips(len(t)):
                i, j = np.nonzero(near[rows])
                cols = (t[rows][i], f[j], luma_scores(td[rows], fd)[i, j].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["target", "frame_id", "similarity"])

    return met(descriptors, targets, "luma").mapInArrow(work, "target long, frame_id long, similarity long")


def luma_counts(descriptors: DataFrame, targets: DataFrame) -> DataFrame:
    """(similarity, n): how many pairs of :func:`luma_near` have a score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(px.SCALE + 1, np.int64)
        for t, td, f, fd, near in _each(batches):
            for rows in _strips(len(t)):
                n += np.bincount(luma_scores(td[rows], fd)[near[rows]], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["similarity", "n"])

    return met(descriptors, targets, "luma").mapInArrow(work, "similarity long, n long")


class _Best:
    """Of a block of targets: the candidates and matches so far, and the best frames."""

    def __init__(self, ids: np.ndarray, cap: int):
        self.ids, self.candidates, self.matched = ids, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self.scores, self.frames = np.full((len(ids), cap), -1, np.int64), np.full((len(ids), cap), np.iinfo(np.int64).max)

    def take(self, rows: slice, i: np.ndarray, frames: np.ndarray, scores: np.ndarray) -> None:
        """More frames of targets i of the rows."""
        n, cap = self.scores[rows].shape
        i, scores, frames = (np.concatenate([x, y]) for x, y in ((np.repeat(np.arange(n), cap), i), (self.scores[rows].ravel(), scores), (self.frames[rows].ravel(), frames)))
        order = np.lexsort((frames, -scores, i))
        at = np.searchsorted(i[order], np.arange(n))  # every target has cap entries at least
        order = order[(at[:, None] + np.arange(cap)).ravel()]
        self.scores[rows], self.frames[rows] = scores[order].reshape(n, cap), frames[order].reshape(n, cap)

    def batch(self) -> pa.RecordBatch:
        i, k = np.nonzero(self.scores >= 0)
        none = np.full(len(self.ids), -1, np.int64)
        cols = zip((self.ids, none, none, self.candidates, self.matched), (self.ids[i], self.frames[i, k], self.scores[i, k], 0 * i, 0 * i))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["target", "frame_id", "similarity", "candidates", "matched"])


def best_near(descriptors: DataFrame, targets: DataFrame, data: str, scan: Callable, least: int, cap: int) -> DataFrame:
    """The part of :func:`top` of pairs near in colour: for each task and block of targets
    a row of the counts of each target (similarity -1), and its ``cap`` best frames."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[_Best, dict]] = {}
        for t, td, f, fd, near in _each(batches):
            key = t.tobytes()
            if key not in kept:
                if len(kept) >= KEPT:
                    yield kept.pop(next(iter(kept)))[0].batch()
                kept[key] = _Best(t.copy(), cap), {}
            best, memo = kept[key]
            best.candidates += near.sum(1)
            scan(best, memo, td, f, fd, near, least)
        for best, _ in kept.values():
            yield best.batch()

    return met(descriptors, targets, data).mapInArrow(work, "target long, frame_id long, similarity long, candidates long, matched long")


def scan_luma(best: _Best, memo: dict, td: np.ndarray, f: np.ndarray, fd: np.ndarray, near: np.ndarray, least: int) -> None:
    for rows in _strips(len(td)):
        s = luma_scores(td[rows], fd)
        match = near[rows] & (s >= least)
        best.matched[rows] += match.sum(1)
        i, j = np.nonzero(match & (s >= best.scores[rows, -1:]))
        best.take(rows, i, f[j], s[i, j].astype(np.int64))


def _squares(raw: np.ndarray) -> np.ndarray:
    """n x 768 bytes as n x 16 x 16 x 3, or x 1 if all are grey."""
    x = raw.reshape(-1, px.SIDE, px.SIDE, 3)
    return x[..., :1] if (x == x[..., :1]).all() else x


def scan_pictures(best: _Best, memo: dict, td: np.ndarray, f: np.ndarray, fd: np.ndarray, near: np.ndarray, least: int) -> None:
    """A pair without a move that is a match is one; its likeness is needed only if it
    may be among the best. Of the others it is needed if it may be a match."""
    x, y = _squares(td), _squares(fd)
    if x.shape[-1] != y.shape[-1]:
        x, y = (v if v.shape[-1] == 3 else np.repeat(v, 3, 3) for v in (x, y))
    planes = x.shape[-1]
    a = memo[planes] if planes in memo else memo.setdefault(planes, px.Views(x))
    b = px.Views(y)
    flat = lambda v: np.moveaxis(v.reshape(len(v), -1, planes), 2, 1)
    whole = flat(y)
    cap = best.scores.shape[1]
    for rows in _strips(len(x)):
        n = near[rows]
        d = px.sums_of_differences(flat(x[rows]), whole)
        sure = n & (d <= px.most_difference(least, x[0].size))
        rest = n & ~sure
        best.matched[rows] += sure.sum(1)
        floor = np.maximum(best.scores[rows, -1], least)
        if (best.scores[rows, -1] < 0).any() and n.shape[1] > cap:
            # the likeness without a move of the cap-th best is one that the cap best reach
            s = np.where(n, px.basis_points(d, x[0].size), -1)
            floor = np.maximum(floor, np.partition(s, -cap, axis=1)[:, -cap])
        s = px.likeness_above(a, rows, b, [(n, floor), *([(rest, np.full(len(floor), least))] if rest.any() else [])])
        best.matched[rows] += (rest & (s >= least)).sum(1)
        i, j = np.nonzero(s >= floor[:, None])
        best.take(rows, i, f[j], s[i, j].astype(np.int64))


def top_of_parts(near: DataFrame, scored: DataFrame, least: int, cap: int) -> DataFrame:
    """The rows of :func:`best_near` and scored pairs beside them -> the report of :func:`top`."""
    hit = F.col("similarity") >= least
    every = Window.partitionBy("target")
    return (
        near.union(scored.select("target", "frame_id", "similarity", F.lit(1).cast("long"), hit.cast("long")))
        .withColumns({c: F.sum(c).over(every) for c in ("candidates", "matched")})
        .filter(hit)
        .withColumn("rank", F.row_number().over(every.orderBy(F.desc("similarity"), "frame_id")).cast("long"))
        .filter(F.col("rank") <= cap)
        .withColumn("truncated", F.col("matched") > cap)
        .select("target", "rank", "frame_id", "similarity", "candidates", "matched", "truncated")
    )


def top(scored: DataFrame, least: int = MINIMUM, cap: int = CAP) -> DataFrame:
    """The ``cap`` most alike of each target, equal ones by id, with the number of
    candidates and of matches before the cap."""
    every = Window.partitionBy("target")
    return (
        scored.withColumn("candidates", F.count("*").over(every))
        .filter(F.col("similarity") >= least)
        .withColumn("matched", F.count("*").over(every))
        .withColumn("rank", F.row_number().over(every.orderBy(F.desc("similarity"), "frame_id")).cast("long"))
        .filter(F.col("rank") <= cap)
        .withColumn("truncated", F.col("matched") > cap)
        .select("target", "rank", "frame_id", "similarity", "candidates", "matched", "truncated")
    )


def similar_frames(descriptors: DataFrame, targets: DataFrame, least: int = MINIMUM, cap: int = CAP) -> DataFrame:
    """Descriptors with buckets and the targets among them -> the report of :func:`top`."""
    if not 0 <= least <= px.SCALE or cap <= 0:
        raise ValueError("minimum within 0..10000 and a positive cap")
    near = best_near(descriptors, targets, "rgb", scan_pictures, least, cap)
    return top_of_parts(near, confirm(by_band(descriptors, targets), descriptors), least, cap)
