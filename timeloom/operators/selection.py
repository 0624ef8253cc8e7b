"""Selections: plans over ranges, every n-th frame, manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import KEY, asof


class SelectionError(ValueError):
    """A request that can't be planned."""


@dataclass(frozen=True)
class Request:
    """``kind``: current, frames, time or all; ``start`` and ``end`` inclusive."""

    kind: str = "all"
    start: int | None = None
    end: int | None = None
    every_n: int = 1
    image: str = "png"

    def check(self) -> Request:
        if self.kind not in ("current", "frames", "time", "all"):
            raise SelectionError(f"unknown selection {self.kind!r}")
        if self.every_n <= 0:
            raise SelectionError("every_n isn't positive")
        if self.kind in ("frames", "time"):
            if self.start is None or self.end is None:
                raise SelectionError("a range needs both ends")
            if self.start > self.end:
                raise SelectionError("the range is inverted")
        if self.kind == "current" and self.start is None:
            raise SelectionError("no current frame")
        return self


def plan(frames: DataFrame, request: Request) -> DataFrame:
    """first, last, stride and count of each source; sources in which the request
    has no frames, or whose ids leave the index, aren't planned.

    A time range finds its ends as of the times, then takes the whole interval of
    ids between, whatever times the frames inside have.
    """
    request.check()
    n = frames.groupBy(KEY).agg(F.count("*").alias("n"))
    if request.kind == "all":
        ends = n.select(KEY, "n", F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))
    elif request.kind == "time":
        probe = lambda t: n.select(KEY, F.lit(0).cast("long").alias("probe_no"), F.lit(t).cast("long").alias("target"))
        a = asof(frames, probe(request.start), "after").select(KEY, F.col("found").alias("a"))
        b = asof(frames, probe(request.end), "before").select(KEY, F.col("found").alias("b"))
        ends = n.join(a, KEY).join(b, KEY).select(KEY, "n", "a", "b")
    else:
        last = request.start if request.kind == "current" else request.end
        ends = n.select(KEY, "n", F.lit(request.start).cast("long").alias("a"), F.lit(last).cast("long").alias("b"))
    e = request.every_n
    good = ends.filter("a is not null and b is not null and a >= 0 and a <= b and b < n")
    count = F.expr(f"(b - a) div {e} + 1")
    return good.select(KEY, F.col("a").alias("first"), (F.col("a") + (count - 1) * e).alias("last"), F.lit(e).cast("long").alias("stride"), count.alias("selected"))


def execute(frames: DataFrame, plans: DataFrame) -> DataFrame:
    """The planned frames with ordinal (from 1) and total; nothing after the last
    selected one is looked at."""
    j = frames.join(plans, KEY).filter("frame_id between first and last and (frame_id - first) % stride = 0")
    w = Window.partitionBy(KEY).orderBy("frame_id")
    return j.withColumn("ordinal", F.row_number().over(w).cast("long")).withColumn("total", F.col("selected"))


def enumerate_plan(plans: DataFrame) -> DataFrame:
    """The ids of a plan without a look at the frames."""
    return plans.select(KEY, F.explode(F.sequence("first", "last", "stride")).alias("frame_id"))


def file_name(frame_id, image: str = "png"):
    """frame_, the id in 20 digits, the extension."""
    return F.concat(F.lit("frame_"), F.lpad(frame_id.cast("string"), 20, "0"), F.lit(f".{image}"))


def manifest(selected: DataFrame, request: Request, sizes=None) -> DataFrame:
    """JSON lines of an export: per source a header, a line for each frame and a
    terminal line; (source_key, section, ordinal, line).

    ``sizes`` is the column of the bytes that a sink has committed; frames
    without one aren't in the manifest, and the terminal line says whether all are.
    """
    done = selected.withColumn("bytes", sizes if sizes is not None else F.lit(1).cast("long"))
    lines = done.filter("bytes > 0")
    selection = F.struct(F.lit(request.kind).alias("kind"), F.lit(request.start).cast("long").alias("start"), F.lit(request.end).cast("long").alias("end"))
    head = done.groupBy(KEY).agg(F.max("total").alias("total")).select(
        KEY, F.lit(0).alias("section"), F.lit(0).cast("long").alias("ordinal"),
        F.to_json(F.struct(F.lit("header").alias("type"), F.lit(1).alias("version"), selection.alias("selection"), F.lit(request.every_n).alias("every_n"), F.lit(request.image).alias("format"), "total")).alias("line"),
    )
    body = lines.select(
        KEY, F.lit(1).alias("section"), "ordinal",
        F.to_json(F.struct(F.lit("frame").alias("type"), "ordinal", "total", "frame_id", "ticks", "duration_ticks", file_name(F.col("frame_id"), request.image).alias("file"), "bytes")).alias("line"),
    )
    tail = done.groupBy(KEY).agg(F.max("total").alias("expected"), F.count_if(F.col("bytes") > 0).alias("emitted")).select(
        KEY, F.lit(2).alias("section"), F.lit(0).cast("long").alias("ordinal"),
        F.to_json(F.struct(F.lit("terminal").alias("type"), F.when(F.col("expected") == F.col("emitted"), "complete").otherwise("failed").alias("status"), "expected", "emitted")).alias("line"),
    )
    return head.union(body).union(tail)
