"""Adjacent near-duplicates: runs, greedy groups and their validation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import KEY


def exact_runs(frames: DataFrame, value: str) -> DataFrame:
    """Maximal runs of equal values: equality with the frame before is equality
    with the first of the run, so a running count of changes numbers them."""
    w = Window.partitionBy(KEY).orderBy("frame_id")
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag("frame_id").over(w).isNull()
    runs = frames.withColumn("ordinal", F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(KEY, "ordinal").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("frames"), F.min("frame_id").alias("representative"))


def score(a: int, b: int) -> int:
    """Similarity of two luma values in basis points, halves of the difference up."""
    return 10000 - (abs(a - b) * 10000 + 127) // 255


GROUPS = f"{KEY} long, ordinal long, first long, last long, frames long, floor int"


def _fold(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows go by once; the open group is all the state there is, so a
    source of any length needs no more memory than one batch."""
    schema = pa.schema([(KEY, pa.int64()), ("ordinal", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("frames", pa.int64()), ("floor", pa.int32())])
    src, ordinal, first, last, rep, prev, low = None, 0, 0, 0, 0, 0, 10000
    for batch in batches:
        out = []
        for s, f, v in zip(*(batch.column(c).to_pylist() for c in (KEY, "frame_id", "value"))):
            if s == src:
                if f != last + 1:
                    raise ValueError(f"source {s}: frame {f} after {last}")
                to_rep = score(rep, v)
                if score(prev, v) >= least and to_rep >= least:
                    last, prev, low = f, v, min(low, to_rep)
                    continue
            if src is not None:
                out.append((src, ordinal, first, last, last - first + 1, low))
            ordinal = ordinal + 1 if s == src else 0
            src, first, last, rep, prev, low = s, f, f, v, v, 10000
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    if src is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((src, ordinal, first, last, last - first + 1, low), schema.types)], schema=schema)


def greedy_groups(frames: DataFrame, value: str, least: int = 9700) -> DataFrame:
    """A frame joins the open group if it is like both the frame before and the
    first of the group; the floor is the lowest accepted likeness to the first.

    The order matters within a source, so each source is one sorted run of one
    task; sources are dealt over the tasks and stream through them.
    """
    rows = frames.select(KEY, "frame_id", F.col(value).cast("long").alias("value"))
    dealt = rows.repartition(KEY).sortWithinPartitions(KEY, "frame_id")
    return dealt.mapInArrow(lambda it, n=least: _fold(n, it), GROUPS)


def hybrid_groups(frames: DataFrame, max_distance: int = 8, least: int = 9700) -> DataFrame:
    """Groups by a hash gate and a pixel check: columns ``hash`` (long) and
    ``value`` (long).  Too far a hash rejects before pixels are compared."""
    dealt = frames.select(KEY, "frame_id", "hash", "value").repartition(KEY).sortWithinPartitions(KEY, "frame_id")
    return dealt.mapInArrow(lambda it, d=max_distance, n=least: _hybrid(d, n, it), GROUPS)


def _hybrid(far: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5 + [pa.int32()]
    names = [KEY, "ordinal", "first", "last", "frames", "floor"]
    open_, out = None, []
    for batch in batches:
        for s, f, h, v in zip(*(batch.column(c).to_pylist() for c in (KEY, "frame_id", "hash", "value"))):
            if open_ is not None and open_["s"] == s:
                near = all(((x ^ h) & (2**64 - 1)).bit_count() <= far for x in (open_["ph"], open_["rh"]))
                to_rep = score(open_["rv"], v) if near else 0
                if near and score(open_["pv"], v) >= least and to_rep >= least:
                    open_ |= {"last": f, "ph": h, "pv": v, "low": min(open_["low"], to_rep)}
                    continue
            if open_ is not None:
                out.append((open_["s"], open_["n"], open_["first"], open_["last"], open_["last"] - open_["first"] + 1, open_["low"]))
            n = open_["n"] + 1 if open_ is not None and open_["s"] == s else 0
            open_ = {"s": s, "n": n, "first": f, "last": f, "rh": h, "ph": h, "rv": v, "pv": v, "low": 10000}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if open_ is not None:
        last = (open_["s"], open_["n"], open_["first"], open_["last"], open_["last"] - open_["first"] + 1, open_["low"])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types)], names)


def group_faults(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Sources whose groups don't tile 0..count-1, and the first fault in each."""
    w = Window.partitionBy(KEY).orderBy("ordinal")
    g = groups.join(counts.select(KEY, "n"), KEY).withColumn("before", F.lag("last").over(w)).withColumn("after", F.lead("first").over(w))
    fault = (
        F.when(F.col("last") < F.col("first"), "bounds").when(F.col("frames") != F.col("last") - F.col("first") + 1, "count")
        .when(F.col("before").isNull() & (F.col("first") != 0), "late start")
        .when(F.col("before").isNotNull() & (F.col("first") > F.col("before") + 1), "gap").when(F.col("first") <= F.col("before"), "overlap")
        .when(F.col("after").isNull() & (F.col("last") != F.col("n") - 1), "early end")
    )
    return g.withColumn("fault", fault).filter("fault is not null").groupBy(KEY).agg(F.min_by("fault", "ordinal").alias("fault"), F.count("*").alias("faults"))


def containing(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """The group of each wanted (source_key, frame_id).  Groups tile the line, so
    the last group that starts at or before the frame is the one."""
    g = groups.select(KEY, F.col("first").alias("at"), F.struct("ordinal", "first", "last").alias("g"), F.lit(None).cast("long").alias("frame_id"), F.lit(0).alias("late"))
    p = wanted.select(KEY, F.col("frame_id").alias("at"), F.lit(None).cast("struct<ordinal:bigint,first:bigint,last:bigint>").alias("g"), "frame_id", F.lit(1).alias("late"))
    w = Window.partitionBy(KEY).orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    x = g.union(p).withColumn("in", F.last("g", ignorenulls=True).over(w)).filter("frame_id is not null")
    return x.select(KEY, "frame_id", F.when(F.col("frame_id") <= F.col("in.last"), F.col("in.ordinal")).alias("ordinal"))


def neighbours(groups: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("ordinal")
    return groups.select(KEY, "ordinal", F.lag("first").over(w).alias("previous_first"), F.lead("first").over(w).alias("next_first"))


def representatives(frames: DataFrame, groups: DataFrame) -> DataFrame:
    """The frames that stand for a group."""
    reps = groups.select(KEY, F.col("first").alias("frame_id"))
    return frames.join(reps, [KEY, "frame_id"], "left_semi")
