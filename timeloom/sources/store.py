"""Derived tables of a source: open, append, truncate, publish.

A store is a folder with ``frames`` (Parquet), and ``meta`` beside it, which is
written after the data: a reader trusts only what meta says is complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
META = "source_key string, version int, lifecycle string, identity string, indexed_frames long, frame_count long, generation long"


class StoreError(RuntimeError):
    """A write that would break the table."""


@dataclass(frozen=True)
class Opened:
    disposition: str
    indexed_frames: int
    path: str


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    _delete(spark, new)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise StoreError(f"can't move {old} to {new}")


class FrameStore:
    def __init__(self, spark: SparkSession, path: str, source_key: str, identity: str):
        self.spark, self.path, self.source_key, self.identity = spark, path.rstrip("/"), source_key, identity

    def meta(self):
        """The one row of the store, or None."""
        if not _exists(self.spark, f"{self.path}/meta"):
            return None
        return self.spark.read.schema(META).parquet(f"{self.path}/meta").first()

    def _set(self, lifecycle: str, frames: int, count: int | None, generation: int) -> None:
        row = [(self.source_key, VERSION, lifecycle, self.identity, frames, count, generation)]
        self.spark.createDataFrame(row, META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta-new")
        _move(self.spark, f"{self.path}/meta-new", f"{self.path}/meta")

    def frames(self) -> DataFrame:
        m = self.meta()
        if m is None or m["indexed_frames"] == 0:
            raise StoreError("nothing is indexed")
        # rows of an append that never came to its meta row aren't part of the table
        return self.spark.read.parquet(f"{self.path}/frames-{m['generation']}").filter(F.col("frame_id") < m["indexed_frames"])

    def open(self) -> Opened:
        """created, reused, recovered (building went on), or rebuilt because the
        version or the identity is another."""
        m = self.meta()
        if m is None:
            self._set("building", 0, None, 1)
            return Opened("created", 0, self.path)
        if m["version"] != VERSION or m["identity"] != self.identity or m["source_key"] != self.source_key:
            self.clear()
            return Opened("rebuilt-version" if m["version"] != VERSION else "rebuilt-identity", 0, self.path)
        return Opened("reused" if m["lifecycle"] == "complete" else "recovered", m["indexed_frames"], self.path)

    def clear(self) -> None:
        m = self.meta()
        self._set("building", 0, None, (m["generation"] if m else 0) + 1)
        if m:
            _delete(self.spark, f"{self.path}/frames-{m['generation']}")

    def append(self, batch: DataFrame) -> int:
        """Append frames that go on without a gap; data first, then meta."""
        m = self.meta()
        if m is None or m["lifecycle"] == "complete":
            raise StoreError("the store isn't open for writing")
        s = batch.agg(F.count("*").alias("n"), F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), F.countDistinct("frame_id").alias("d")).first()
        if not s["n"]:
            return m["indexed_frames"]
        at = m["indexed_frames"]
        if s["lo"] != at or s["hi"] != at + s["n"] - 1 or s["d"] != s["n"]:
            raise StoreError(f"frames {s['lo']}..{s['hi']} don't follow {at - 1}")
        target = f"{self.path}/frames-{m['generation']}"
        if _exists(self.spark, target) and self.spark.read.parquet(target).filter(F.col("frame_id") >= at).limit(1).count():
            self.truncate(at)  # what an append left that was lost before its meta row
            target = f"{self.path}/frames-{self.meta()['generation']}"
            m = self.meta()
        batch.write.mode("append").parquet(target)
        self._set("building", at + s["n"], None, m["generation"])
        return at + s["n"]

    def truncate(self, frame_id: int) -> None:
        """Drop the frames from ``frame_id`` on: the rest is written as the next generation."""
        m = self.meta()
        keep, g = min(frame_id, m["indexed_frames"]), m["generation"]
        old = f"{self.path}/frames-{g}"
        if keep:
            self.spark.read.parquet(old).filter(F.col("frame_id") < keep).write.parquet(f"{self.path}/frames-{g + 1}")
        self._set("building", keep, None, g + 1)
        _delete(self.spark, old)

    def mark(self, lifecycle: str) -> None:
        """complete (which fixes the frame count), incomplete or failed."""
        if lifecycle not in ("complete", "incomplete", "failed", "building"):
            raise StoreError(f"unknown lifecycle {lifecycle!r}")
        m = self.meta()
        n = m["indexed_frames"]
        if lifecycle == "complete" and n and self.frames().count() != n:
            raise StoreError("rows are missing")
        self._set(lifecycle, n, n if lifecycle == "complete" else None, m["generation"])


def dispositions(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """What opening each of ``wanted`` (source_key, identity) finds in ``stored``
    (as ``META``): created, rebuilt because the version or else the identity is
    another, recovered where building went on, or reused; and the frames that
    stay indexed."""
    s = stored.withColumnRenamed("identity", "__own")
    other = F.when(F.col("version").isNull(), "created").when(F.col("version") != VERSION, "rebuilt-version").when(~F.col("__own").eqNullSafe(F.col("identity")), "rebuilt-identity")
    found = F.coalesce(other, F.when(F.col("lifecycle") == "complete", "reused").otherwise("recovered"))
    return wanted.join(s, "source_key", "left").select("source_key", found.alias("disposition"), F.when(other.isNull(), F.col("indexed_frames")).otherwise(0).cast("long").alias("indexed_frames"))


class FrameStores:
    """Stores of any number of sources in one folder: their frames in one table a
    generation, and a row of meta for each, published after the frames."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 256):
        self.spark, self.path, self.batch = spark, path.rstrip("/"), batch

    def meta(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/meta"):
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).parquet(f"{self.path}/meta")

    def _generation(self) -> int:
        return self.meta().agg(F.coalesce(F.max("generation"), F.lit(1))).first()[0]

    def _counts(self) -> DataFrame:
        return self.meta().select(F.col("source_key").alias("__source"), F.col("indexed_frames").alias("__indexed"), F.col("lifecycle").alias("__lifecycle"))

    def frames(self) -> DataFrame:
        """What meta vouches for: rows of an append that was lost aren't part of it."""
        f = self.spark.read.parquet(f"{self.path}/frames-{self._generation()}")
        return f.join(self._counts(), F.col("source_key").cast("string") == F.col("__source")).filter("frame_id < __indexed").drop("__source", "__indexed", "__lifecycle")

    def append(self, frames: DataFrame, identity: str = "") -> None:
        """Append the frames of many sources, each going on without a gap where it
        stands, in batches of ``batch`` rows; all of them or none."""
        key = F.col("source_key").cast("string")
        n = frames.groupBy(key.alias("source_key")).agg(F.count("*").alias("n"), F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), F.countDistinct("frame_id").alias("d"))
        n = n.join(self._counts(), F.col("source_key") == F.col("__source"), "left").withColumn("at", F.coalesce("__indexed", F.lit(0)))
        wrong = F.coalesce(F.col("__lifecycle") == "complete", F.lit(False)) | (F.col("lo") != F.col("at")) | (F.col("hi") != F.col("at") + F.col("n") - 1) | (F.col("d") != F.col("n"))
        if bad := n.filter(wrong).select("source_key", "lo", "hi", "at").first():
            raise StoreError(f"frames {bad['lo']}..{bad['hi']} of {bad['source_key']} don't follow {bad['at'] - 1} of an open store")
        g = self._generation()
        target = f"{self.path}/frames-{g}"
        if _exists(self.spark, target):
            left = self.spark.read.parquet(target).join(self._counts(), key == F.col("__source"), "left").filter("frame_id >= coalesce(__indexed, 0)")
            if left.limit(1).count():  # of an append that was lost before its meta rows
                self._rewrite(self.frames(), g + 1)
                _delete(self.spark, target)
                return self.append(frames, identity)
        frames.withColumn("batch", F.expr(f"frame_id div {self.batch}")).repartition("source_key", "batch").sortWithinPartitions("source_key", "frame_id").write.mode("append").parquet(target)
        new = n.select("source_key", F.lit(VERSION).alias("version"), F.lit("building").alias("lifecycle"), F.lit(identity).alias("identity"), (F.col("at") + F.col("n")).alias("indexed_frames"), F.lit(None).cast("long").alias("frame_count"), F.lit(g).cast("long").alias("generation"))
        publish(self.meta().join(n, "source_key", "left_anti").withColumn("generation", F.lit(g).cast("long")).union(new), f"{self.path}/meta")

    def _rewrite(self, keep: DataFrame, generation: int) -> None:
        keep.write.mode("overwrite").parquet(f"{self.path}/frames-{generation}")
        publish(self.meta().withColumn("generation", F.lit(generation).cast("long")), f"{self.path}/meta")

    def truncate(self, frame_id: int) -> None:
        """Drop all sources' frames from ``frame_id`` on; the rest is the next generation."""
        g = self._generation()
        self.frames().filter(F.col("frame_id") < frame_id).write.mode("overwrite").parquet(f"{self.path}/frames-{g + 1}")
        cut = {"lifecycle": F.lit("building"), "indexed_frames": F.least("indexed_frames", F.lit(frame_id).cast("long")), "frame_count": F.lit(None).cast("long"), "generation": F.lit(g + 1).cast("long")}
        publish(self.meta().withColumns(cut), f"{self.path}/meta")
        _delete(self.spark, f"{self.path}/frames-{g}")

    def mark(self, lifecycle: str, which: Column | None = None) -> None:
        """complete (which fixes the frame counts), incomplete or failed."""
        if lifecycle not in ("complete", "incomplete", "failed", "building"):
            raise StoreError(f"unknown lifecycle {lifecycle!r}")
        which = F.lit(True) if which is None else which
        if lifecycle == "complete":
            there = self.frames().groupBy(F.col("source_key").cast("string").alias("source_key")).agg(F.count("*").alias("there"))
            short = self.meta().filter(which).join(there, "source_key", "left").filter("indexed_frames <> coalesce(there, 0)").first()
            if short:
                raise StoreError(f"rows of {short['source_key']} are missing")
        count = F.col("indexed_frames") if lifecycle == "complete" else F.lit(None).cast("long")
        publish(self.meta().withColumns({"lifecycle": F.when(which, lifecycle).otherwise(F.col("lifecycle")), "frame_count": F.when(which, count).otherwise(F.col("frame_count"))}), f"{self.path}/meta")


def publish(df: DataFrame, path: str) -> None:
    """All or nothing: written beside its place, then moved there."""
    df.write.mode("overwrite").parquet(f"{path}.building")
    _move(df.sparkSession, f"{path}.building", path)


def open_or_build(spark: SparkSession, path: str, valid, build) -> tuple[DataFrame, str]:
    """The table at ``path`` if ``valid`` holds for it, else what ``build`` makes,
    published and checked again."""
    if _exists(spark, path):
        df = spark.read.parquet(path)
        if valid(df):
            return df, "reused"
    publish(build(), path)
    df = spark.read.parquet(path)
    if not valid(df):
        raise StoreError(f"what was built at {path} isn't valid")
    return df, "built"
