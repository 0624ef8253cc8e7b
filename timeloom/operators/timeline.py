"""Lookups, anchors, segments and checks on frame timelines.

A timeline has the columns ``source_key``, ``frame_id`` (dense, from 0), ``ticks``
(nullable), ``duration_ticks`` (nullable), ``keyframe`` and ``corrupt``.  Windows
are partitioned by source, so nothing is sorted across sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "source_key"
# Frames that a resumed run reads again.
OVERLAP_LEAST, OVERLAP_MOST = 32, 4096


def ordered(*more) -> Window:
    return Window.partitionBy(KEY).orderBy("frame_id", *more)


def clean_keyframe() -> Column:
    return F.col("keyframe") & ~F.col("corrupt")


def lookup(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted (source_key, frame_id)."""
    return wanted.join(frames, [KEY, "frame_id"])


def asof(frames: DataFrame, probes: DataFrame, side: str = "before") -> DataFrame:
    """``probes`` (source_key, probe_no, target) with ``found``: the last frame at
    or before the target, of equal times the greatest id; or with ``side``
    "after" the first at or after it, of equal times the smallest id.  Frames
    without a time never match.

    Probes and frames of a source are merged in time order and the nearest frame
    is carried over, one sort per source and no join of ranges.
    """
    before = side == "before"
    f = frames.filter("ticks is not null").select(KEY, F.col("ticks").alias("t"), "frame_id", F.lit(None).cast("long").alias("probe_no"), F.lit(0 if before else 1).alias("late"))
    p = probes.select(KEY, F.col("target").alias("t"), F.lit(None).cast("long").alias("frame_id"), "probe_no", F.lit(1 if before else 0).alias("late"))
    w = Window.partitionBy(KEY).orderBy("t", "late", "frame_id")
    if before:
        found = F.last("frame_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ticks = F.last(F.when(F.col("frame_id").isNotNull(), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("frame_id", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        ticks = F.first(F.when(F.col("frame_id").isNotNull(), F.col("t")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return f.union(p).withColumns({"found": found, "found_ticks": ticks}).filter("probe_no is not null").select(KEY, "probe_no", F.col("t").alias("target"), "found", "found_ticks")


def nearest(frames: DataFrame, probes: DataFrame) -> DataFrame:
    """The nearest frame in time: of an exact hit the first equal one, at equal
    distance the earlier one."""
    a = asof(frames, probes, "before").select(KEY, "probe_no", "target", F.col("found").alias("b"), F.col("found_ticks").alias("bt"))
    c = asof(frames, probes, "after").select(KEY, "probe_no", F.col("found").alias("a"), F.col("found_ticks").alias("at"))
    exact = F.col("at") == F.col("target")
    pick = (
        F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | exact, F.col("a"))
        .when(F.col("target") - F.col("bt") <= F.col("at") - F.col("target"), F.col("b")).otherwise(F.col("a"))
    )
    return a.join(c, [KEY, "probe_no"]).select(KEY, "probe_no", "target", pick.alias("found"))


def reconcile(indexed: DataFrame, decoded: DataFrame) -> DataFrame:
    """Frames on which index and decoder differ, and how."""
    cols = ("ticks", "duration_ticks", "keyframe", "corrupt")
    a = indexed.select(KEY, "frame_id", F.struct(*cols).alias("i"))
    b = decoded.select(KEY, "frame_id", F.struct(*cols).alias("d"))
    j = a.join(b, [KEY, "frame_id"], "full")
    what = F.when(F.col("i").isNull(), "extra").when(F.col("d").isNull(), "missing")
    for c in cols:
        what = what.when(~F.col(f"i.{c}").eqNullSafe(F.col(f"d.{c}")), c)
    return j.select(KEY, "frame_id", what.alias("difference")).filter("difference is not null")


def anchors(frames: DataFrame) -> DataFrame:
    """Each frame with the last clean keyframe at or before it; null is the
    start of the stream."""
    key = F.when(clean_keyframe(), F.struct(F.col("frame_id").alias("f"), F.col("ticks").alias("t")))
    a = F.last(key, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("__a", a).withColumns({"anchor_frame": F.col("__a.f"), "anchor_ticks": F.col("__a.t")}).drop("__a")


def bad_anchors(anchored: DataFrame) -> DataFrame:
    """Frames whose stored anchor isn't a clean keyframe with the stored time."""
    a = anchored.select(KEY, F.col("frame_id").alias("anchor_frame"), F.col("ticks").alias("t"), clean_keyframe().alias("ok"))
    return (
        anchored.filter("anchor_frame is not null")
        .join(a, [KEY, "anchor_frame"], "left")
        .filter(~F.coalesce("ok", F.lit(False)) | ~F.col("t").eqNullSafe(F.col("anchor_ticks")))
        .select(KEY, "frame_id", "anchor_frame")
    )


def segments(frames: DataFrame) -> DataFrame:
    """Groups of pictures: clean keyframes, numbered, up to the next one."""
    counts = frames.groupBy(KEY).agg(F.count("*").alias("frames"))
    w = ordered()
    k = frames.filter(clean_keyframe()).select(
        KEY, (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.col("frame_id").alias("first"), F.col("ticks").alias("start_ticks"),
        F.lead("frame_id").over(w).alias("nxt"), F.lead("ticks").over(w).alias("end_ticks"),
    )
    return k.join(counts, KEY).select(KEY, "ordinal", "first", F.coalesce("nxt", "frames").alias("end"), "start_ticks", "end_ticks")


def seek_safety(frames: DataFrame) -> DataFrame:
    """Whether clean keyframes have times that strictly increase in frame order."""
    k = frames.filter(clean_keyframe()).withColumn("before", F.lag("ticks").over(ordered())).withColumn("nth", F.row_number().over(ordered()))
    ok = F.col("ticks").isNotNull() & ((F.col("nth") == 1) | (F.coalesce(F.col("ticks") > F.col("before"), F.lit(False))))
    return frames.select(KEY).distinct().join(k.groupBy(KEY).agg(F.bool_and(ok).alias("ok")), KEY, "left").select(KEY, F.coalesce("ok", F.lit(True)).alias("seek_safe"))


def cadence(frames: DataFrame) -> DataFrame:
    """constant, variable or unknown, over the frames that have times: any step
    that isn't positive or isn't the first one is variable; constant takes two
    steps at least."""
    w = ordered()
    t = frames.filter("ticks is not null").withColumn("step", F.col("ticks") - F.lag("ticks").over(w))
    t = t.withColumn("one", F.first("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    odd = F.coalesce((F.col("step") <= 0) | (F.col("step") != F.col("one")), F.lit(False))
    g = t.groupBy(KEY).agg(F.bool_or(odd).alias("odd"), F.count("step").alias("steps"))
    kind = F.when(F.col("odd"), "variable").when(F.col("steps") >= 2, "constant").otherwise("unknown")
    return g.select(KEY, kind.alias("cadence"), "steps")


def contiguity(frames: DataFrame) -> DataFrame:
    """Whether ids are 0..n-1 without gap or repeat."""
    g = frames.groupBy(KEY).agg(F.count("*").alias("n"), F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), F.countDistinct("frame_id").alias("d"))
    return g.select(KEY, "n", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("dense"))


def row_faults(anchored: DataFrame) -> DataFrame:
    """The first rule that each broken row breaks."""
    rule = (
        F.when(F.col("frame_id") < 0, "id").when(F.col("duration_ticks") <= 0, "duration")
        .when(F.col("anchor_frame") > F.col("frame_id"), "anchor after frame")
        .when(F.col("anchor_frame").isNull() & F.col("anchor_ticks").isNotNull(), "anchor time alone")
        .when(clean_keyframe() & ~F.col("anchor_frame").eqNullSafe(F.col("frame_id")), "keyframe not its own anchor")
        .when(F.col("keyframe").isNull() | F.col("corrupt").isNull(), "flags")
    )
    return anchored.select(KEY, "frame_id", rule.alias("fault")).filter("fault is not null")


def status(frames: DataFrame) -> DataFrame:
    """Count, last frame and the last time that a frame has."""
    timed = F.struct("frame_id", "ticks")
    return frames.groupBy(KEY).agg(
        F.count("*").alias("indexed_frames"), F.max("frame_id").alias("last_frame"),
        F.max(F.when(F.col("ticks").isNotNull(), timed)).getField("ticks").alias("last_ticks"),
    )


def resume_points(anchored: DataFrame, safety: DataFrame, overlap: int = OVERLAP_LEAST) -> DataFrame:
    """Where indexing goes on: from the anchor of the frame ``overlap`` before the
    end, if the source is safe to seek and no more than ``OVERLAP_MOST`` frames
    are read again; else from the start."""
    n = anchored.groupBy(KEY).agg(F.count("*").alias("n"))
    at = n.withColumn("frame_id", F.greatest(F.col("n") - overlap, F.lit(0)))
    j = at.join(anchored.select(KEY, "frame_id", "anchor_frame"), [KEY, "frame_id"]).join(safety, KEY)
    good = F.col("seek_safe") & F.col("anchor_frame").isNotNull() & (F.col("n") - F.col("anchor_frame")).between(1, OVERLAP_MOST)
    return j.select(KEY, "n", F.when(good, F.col("anchor_frame")).otherwise(0).alias("resume_frame"), good.alias("by_keyframe"))


def steps(frames: DataFrame) -> DataFrame:
    w = ordered()
    p, n = F.lag("frame_id").over(w), F.lead("frame_id").over(w)
    return frames.select(KEY, "frame_id", p.alias("previous"), n.alias("next"), p.isNotNull().alias("has_previous"), n.isNotNull().alias("has_next"))


def visit(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames of the half-open range, in order."""
    return frames.filter((F.col("frame_id") >= start) & (F.col("frame_id") < end)).orderBy(KEY, "frame_id")


def prefix_match(indexed: DataFrame, decoded: DataFrame) -> DataFrame:
    """Resumable indexing: how long the indexed rows agree with the decoder from
    the start, and whether the rest can be appended or all is built again."""
    d = reconcile(indexed, decoded).filter("difference <> 'extra'")
    first = d.groupBy(KEY).agg(F.min("frame_id").alias("bad"))
    n = indexed.groupBy(KEY).agg(F.count("*").alias("n"))
    m = decoded.groupBy(KEY).agg(F.count("*").alias("decoded"))
    j = n.join(first, KEY, "left").join(m, KEY, "left")
    return j.select(KEY, F.coalesce("bad", "n").alias("valid_prefix"), F.when(F.col("bad").isNull(), "append").otherwise("rebuild").alias("action"),
                    F.greatest(F.coalesce(F.col("decoded"), F.lit(0)) - F.when(F.col("bad").isNull(), F.col("n")).otherwise(0), F.lit(0)).alias("to_write"))
