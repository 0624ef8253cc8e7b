"""Caches over access logs: least recently used, first in first out, prefetch."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how far a decoder goes on before it is opened anew.
REUSE_FRAMES = 48
# Cadences in ms and velocities in frames a second.
SLOWEST_MS, FAST_MS, MEDIUM_MS, FAST_FPS, MEDIUM_FPS = 320, 90, 180, 60.0, 20.0


def counters(log: DataFrame) -> DataFrame:
    """hits, misses and bytes of an access log with the column ``hit``."""
    return log.agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum(F.when(~F.col("hit"), F.col("size"))).cast("long").alias("bytes_loaded"))


class Lru:
    """Least recently used, bounded by bytes and, if wanted, by entries; what is
    larger than the budget is passed by."""

    def __init__(self, budget: int, entries: int | None = None):
        self.budget, self.most, self.held, self.data = budget, entries, 0, OrderedDict()

    def touch(self, key, size: int) -> tuple[bool, int]:
        """(hit, evictions)"""
        if key in self.data:
            self.data.move_to_end(key)
            return True, 0
        if size > self.budget or self.most == 0:
            return False, 0
        self.data[key], self.held, out = size, self.held + size, 0
        while self.held > self.budget or self.most is not None and len(self.data) > self.most:
            self.held -= self.data.popitem(last=False)[1]
            out += 1
        return False, out


class Fifo(Lru):
    """Oldest first: a hit doesn't make an entry younger."""

    def touch(self, key, size: int) -> tuple[bool, int]:
        return (True, 0) if key in self.data else super().touch(key, size)


def simulate(log: DataFrame, kind: str, budget: int, entries: int | None = None) -> DataFrame:
    """The log (cache, seq, key, size) with ``hit`` and ``evicted``, one cache per
    value of ``cache``.  What a cache holds depends on all accesses before, so a
    cache is one sorted run; caches are dealt over the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for b in batches:
            hits, out = [], []
            for c, k, s in zip(*(b.column(x).to_pylist() for x in ("cache", "key", "size"))):
                if state is None or c != name:
                    name, state = c, (Fifo if kind == "fifo" else Lru)(budget, entries)
                h, e = state.touch(k, s)
                hits.append(h)
                out.append(e)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.bool_()), pa.array(out, pa.int64())], [*b.schema.names, "hit", "evicted"])

    rows = log.select("cache", "seq", "key", "size").repartition("cache").sortWithinPartitions("cache", "seq")
    return rows.mapInArrow(work, "cache long, seq long, key long, size long, hit boolean, evicted long")


def lru_hits(log: DataFrame, budget: int) -> DataFrame:
    """LRU hits in closed form, for one size per key: an access hits when the
    distinct keys since the last access of its key, itself among them, fit the
    budget.  ``log``: cache, seq, key, size."""
    w = Window.partitionBy("cache", "key").orderBy("seq")
    x = log.withColumn("prev", F.lag("seq").over(w)).withColumn("next", F.lead("seq").over(w))
    # of the keys touched in (prev, seq), each counts at its last access before seq
    a = x.filter(F.col("prev").isNotNull() & (F.col("size") <= budget)).select("cache", F.col("seq").alias("at"), "prev", F.col("size").alias("own"))
    b = x.filter(F.col("size") <= budget).select("cache", "seq", "size", F.coalesce("next", F.lit(2**62)).alias("next"))
    held = a.join(b, (a["cache"] == b["cache"]) & (b["seq"] > a["prev"]) & (b["seq"] < a["at"]) & (b["next"] >= a["at"])).groupBy(a["cache"], "at").agg(F.sum("size").alias("held"))
    j = x.join(held.withColumnRenamed("at", "seq"), ["cache", "seq"], "left")
    hit = F.col("prev").isNotNull() & (F.coalesce("held", F.lit(0)) + F.col("size") <= budget)
    return j.select("cache", "seq", "key", "size", F.coalesce(hit, F.lit(False)).alias("hit"))


def cursor_reuse(requests: DataFrame, most: int = REUSE_FRAMES) -> DataFrame:
    """Whether a decoder that stands at the frame before can go on to the target:
    forward by up to ``most`` frames.  ``requests``: session, seq, frame_id."""
    w = Window.partitionBy("session").orderBy("seq")
    step = F.col("frame_id") - F.lag("frame_id").over(w)
    ok = F.coalesce((step > 0) & (step <= most), F.lit(False))
    return requests.select("session", "seq", "frame_id", ok.alias("reused"), F.when(ok, step).alias("frames_decoded"))


def prefetch(requests: DataFrame) -> DataFrame:
    """The frame to fetch ahead after each completed one (session, seq, frame_id,
    frame_count, done_ms): steady direction and a quick enough pace."""
    w = Window.partitionBy("session").orderBy("seq")
    x = requests.withColumns({"step": F.col("frame_id") - F.lag("frame_id").over(w), "ms": F.col("done_ms") - F.lag("done_ms").over(w)})
    x = x.withColumn("way", F.when(F.col("step") != 0, F.signum("step").cast("int")))
    x = x.withColumn("was", F.last("way", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fps = F.abs("step") * 1000.0 / F.col("ms")
    ahead = F.when((F.col("ms") <= FAST_MS) | (fps >= FAST_FPS), 3).when((F.col("ms") <= MEDIUM_MS) | (fps >= MEDIUM_FPS), 2).otherwise(1)
    good = F.col("way").isNotNull() & (F.col("was").isNull() | (F.col("was") == F.col("way"))) & (F.col("ms") > 0) & (F.col("ms") <= SLOWEST_MS)
    to = F.col("frame_id") + F.col("way") * ahead
    return x.select("session", "seq", "frame_id", F.when(good & (to >= 0) & (to < F.col("frame_count")), to).alias("candidate"))


def tiered(requests: DataFrame, ram: DataFrame, disk: DataFrame) -> DataFrame:
    """Where each request is answered: memory, else disk, else the decoder."""
    r, d = ram.select("key", F.lit("ram").alias("r")).distinct(), disk.select("key", F.lit("disk").alias("d")).distinct()
    return requests.join(r, "key", "left").join(d, "key", "left").withColumn("tier", F.coalesce("r", "d", F.lit("decode"))).drop("r", "d")


def best_fit(requests: DataFrame, buffers: DataFrame) -> DataFrame:
    """The smallest free buffer that holds each need; ``buffers`` is a small pool."""
    j = requests.join(buffers.select("buffer", "capacity"), F.col("capacity") >= F.col("need"), "left")
    return j.groupBy("request", "need").agg(F.min(F.struct("capacity", "buffer")).alias("b")).select("request", "need", "b.buffer", "b.capacity")
