"""Opening and reading a source: stream selection, seeks, checks against the
index, what navigation cost, and the upkeep of stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import KEY, asof


def select_streams(streams: DataFrame) -> DataFrame:
    """Per source the video stream to decode, or why there is none.

    ``streams``: source_key, stream_index, kind, decodable, is_default and
    requested (one value a source, null for no wish).  A wish must be a decodable
    video stream; without one the first decodable default stream goes before the
    first decodable one.
    """
    video = F.col("kind") == "video"
    usable = video & F.col("decodable")
    wished = video & (F.col("stream_index") == F.col("requested"))
    first = lambda c: F.min(F.when(c, F.col("stream_index")))
    s = streams.groupBy(KEY).agg(
        F.max("requested").alias("requested"), F.count_if(video).alias("videos"), F.count_if(wished).alias("found"),
        first(wished & usable).alias("wish"), F.coalesce(first(usable & F.col("is_default")), first(usable)).alias("own"),
    )
    asked = F.col("requested").isNotNull()
    selected = F.when(asked, F.col("wish")).otherwise(F.col("own"))
    missing = F.when(asked, F.col("found") == 0).otherwise(F.col("videos") == 0)
    error = F.when(selected.isNotNull(), None).when(missing, "no_video_stream").otherwise("unsupported_codec")
    return s.select(KEY, selected.alias("stream_index"), error.alias("error"))


def seek(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """Where decoding begins for each target time (source_key, probe_no, target):
    the last clean keyframe at or before it, else the first frame.  Every accepted
    seek of a source begins a new epoch; a negative time is refused and doesn't."""
    keys = frames.filter(F.col("keyframe") & ~F.col("corrupt"))
    fine = F.col("target") >= 0
    w = Window.partitionBy(KEY).orderBy("probe_no").rowsBetween(Window.unboundedPreceding, 0)
    return asof(keys, targets, "before").select(
        KEY, "probe_no", "target", F.when(fine, F.coalesce("found", F.lit(0))).alias("landing"),
        F.when(fine, F.count_if(fine).over(w)).alias("epoch"), F.when(~fine, "seek_unavailable").alias("error"),
    )


def stream_faults(index: DataFrame, decoded: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """Sources whose decoded frames (in the order ``position``) aren't those of the
    index: how many frames agree before the first fault, and what it is."""
    a = index.select(KEY, F.col("frame_id").alias("position"), "frame_id", F.struct(*same).alias("is"), F.struct("width", "height").alias("size"))
    b = decoded.select(KEY, "position", F.col("frame_id").alias("got"), F.struct(*same).alias("was"), F.struct("width", "height").alias("was_size"))
    x = a.join(b, [KEY, "position"], "full")
    fault = (
        F.when(F.col("was").isNull(), "early end").when(F.col("is").isNull(), "more frames").when(F.col("got") != F.col("frame_id"), "sequence")
        .when(~F.col("is").eqNullSafe(F.col("was")), "timeline").when(~F.col("size").eqNullSafe(F.col("was_size")), "dimensions")
    )
    bad = x.withColumn("fault", fault).filter("fault is not null")
    return bad.groupBy(KEY).agg(F.min("position").alias("agreed"), F.min_by("fault", "position").alias("fault"))


def presentations(requests: DataFrame) -> DataFrame:
    """What each request (source_key, seq, frame_id, anchor_frame, reopens) of an
    exact frame costs a decoder that stays where the last one left it."""
    w = Window.partitionBy(KEY).orderBy("seq")
    at, start = F.lag("frame_id").over(w), F.coalesce("anchor_frame", F.lit(0))
    x = requests.withColumns({"at": F.when(F.col("reopens") == 0, at), "start": start})
    held = F.coalesce(F.col("at") == F.col("frame_id"), F.lit(False))
    onward = F.coalesce((F.col("at") < F.col("frame_id")) & (F.col("start") <= F.col("at")), F.lit(False))
    return x.select(
        KEY, "seq", "reopens", (~held & ~onward).alias("seeks"),
        F.when(held, 0).when(onward, F.col("frame_id") - F.col("at")).otherwise(F.col("frame_id") - F.col("start") + 1).cast("long").alias("decoded"),
        F.when(held | onward, 0).otherwise(F.col("frame_id") - F.col("start")).cast("long").alias("distance"),
    )


def navigation_diagnostics(shown: DataFrame) -> DataFrame:
    """Totals of :func:`presentations` and the last one's own figures."""
    open_ = F.col("reopens") == 0
    warm, ram = open_ & (F.col("decoded") > 0) & ~F.col("seeks"), open_ & (F.col("decoded") == 0)
    last = lambda c: F.max_by(c, "seq").alias(f"last_{c}")
    return shown.groupBy(KEY).agg(
        F.count("*").alias("requested"), F.count_if("seeks").alias("random_seeks"), F.count_if(warm).alias("warm_hits"), F.count_if(ram).alias("ram_hits"),
        F.sum(F.when(warm, F.col("decoded")).otherwise(0)).alias("forward_decodes"), F.sum("reopens").cast("long").alias("reopened"), F.sum("decoded").alias("decoded_frames"),
        F.sum("distance").alias("seek_frames"), last("distance"), last("decoded"), last("seeks"),
    )


SCOPES = ("index", "preview", "other")


def safe_source(key: Column) -> Column:
    return F.coalesce(key.rlike("^[A-Za-z0-9_-]{1,256}$"), F.lit(False))


def clear_reports(files: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request (request, scope, source_key) clears of ``files``
    (category, source_key, bytes).  Scopes are the categories, ``all`` and
    ``source``: the indexes of one source in all schema versions.  A key that
    isn't safe as a name is refused.

    Files are summed by category and source first, so the joins carry sums.
    """
    sums = files.groupBy("category", "source_key").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    one, source = F.col("scope") == "source", F.col("source_key")
    r = requests.withColumn("error", F.when(one & ~safe_source(source), "invalid_source_key"))
    whole = r.filter(~one).withColumn("category", F.explode(F.when(F.col("scope") == "all", F.array(*map(F.lit, SCOPES))).otherwise(F.array("scope"))))
    hit = whole.select("request", "category").join(sums.groupBy("category").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")), "category")
    single = r.filter(one & F.col("error").isNull()).select("request", "source_key").join(sums.filter("category = 'index'"), "source_key")
    got = hit.select("request", "files", "bytes").union(single.select("request", "files", "bytes")).groupBy("request").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    zero = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).alias(c)
    return r.select("request", "error").join(got, "request", "left").select("request", "error", zero("files"), zero("bytes"))


def open_caches(files: DataFrame, budget: int) -> DataFrame:
    """Opening each cache (cache, name, bytes, modified, temporary): temporary
    files go, then the oldest until the rest is within the budget."""
    newer = Window.partitionBy("cache").orderBy(F.desc("modified"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    kept = files.filter(~F.col("temporary")).withColumn("stays", F.sum("bytes").over(newer) <= budget).groupBy("cache").agg(
        F.count_if("stays").alias("resident_files"), F.coalesce(F.sum(F.when(F.col("stays"), F.col("bytes"))), F.lit(0)).cast("long").alias("resident_bytes"),
        F.count_if(~F.col("stays")).alias("evictions"),
    )
    gone = files.groupBy("cache").agg(F.count_if("temporary").alias("temporary_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return gone.join(kept, "cache", "left").select("cache", "temporary_removed", *map(zero, ("resident_files", "resident_bytes", "evictions")))


def choose_decoders(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (mime, buffers) wanted, the first candidate by ``position`` that is
    hardware, no alias (unknown is none), of that kind whatever its case, and
    gives byte buffers where they are wanted; null if there is none."""
    able = candidates.filter((F.col("acceleration") == "Hardware") & ~F.coalesce("alias", F.lit(False)))
    first = lambda c: F.min_by("name", F.when(c, F.col("position"))).alias
    best = able.groupBy("mime").agg(first(F.lit(True))("any"), first(F.col("gives_buffers"))("buffered"))
    w = wanted.withColumn("kind", F.lower("mime")).drop("mime").join(best.withColumnRenamed("mime", "kind"), "kind", "left")
    return w.select(F.col("kind").alias("mime"), "buffers", F.when(F.col("buffers"), F.col("buffered")).otherwise(F.col("any")).alias("decoder"))
