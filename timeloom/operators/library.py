"""The media library and the catalog of stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MOST_RECENT, HOME = 100, 3


def reconcile(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored records with what the catalog now says of their index, and records
    for catalog entries that no stored one represents.

    ``stored``: id, uri, opened_ms, source_key, stream_index; ``catalog``:
    source_key, stream_index, status, frame_count, indexed_frames, modified_ms.
    A record without a binding keeps its status ``Unknown``.
    """
    on = ["source_key", "stream_index"]
    bound = F.col("source_key").isNotNull() & F.col("stream_index").isNotNull()
    c = catalog.select(*on, "status", F.coalesce("frame_count", "indexed_frames").alias("frames"), "modified_ms")
    a = stored.join(c, on, "left").select("id", "uri", "opened_ms", *on, F.when(~bound, "Unknown").otherwise(F.coalesce("status", F.lit("Missing"))).alias("status"), "frames", "modified_ms")
    free = c.join(stored.filter(bound), on, "left_anti")
    b = free.select(F.concat(F.lit("index:"), F.col("source_key"), F.lit(":"), F.col("stream_index")).alias("id"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("long").alias("opened_ms"), *on, "status", "frames", "modified_ms")
    return a.unionByName(b)


def recency() -> Column:
    return F.greatest("opened_ms", F.coalesce("modified_ms", F.lit(0)))


def ordered(records: DataFrame) -> DataFrame:
    """By the later of opening and indexing, then by id."""
    return records.orderBy(recency().desc(), "id")


def numbered(rows: DataFrame, keys: list[Column], name: str = "place", parts: int = 64, sampled: int = 4096) -> DataFrame:
    """``rows`` with their places 1, 2, ... by ``keys``: bounds from a sample deal
    them into ranges, each range is numbered alone and starts behind those before."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    x = rows.withColumn("__key", key)
    kind = x.schema["__key"].dataType.simpleString()
    found = sorted(tuple(r) for (r,) in x.select("__key").orderBy(F.xxhash64("__key")).limit(sampled).collect())
    step = max(1, len(found) // parts)
    bounds = [F.struct(*[F.lit(v) for v in b]).cast(kind) for b in found[step::step]]
    at = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col("__key"))) if bounds else F.lit(0)
    x = x.withColumn("__range", at)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    n = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) + F.col("__start")
    return x.join(F.broadcast(starts), "__range").withColumn(name, n.cast("long")).drop("__range", "__start", "__key")


def normalise(records: DataFrame, position: str = "position", most: int = MOST_RECENT) -> DataFrame:
    """Records with a URI, the first of each id, the ``most`` latest."""
    w = Window.partitionBy("id").orderBy(position)
    r = records.filter("uri is not null").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return r.orderBy(F.desc("opened_ms"), position).limit(most)


def upsert(records: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of the records with its ids or URIs."""
    kept = records.join(new.select("id"), "id", "left_anti").join(new.select("uri").filter("uri is not null"), "uri", "left_anti")
    return kept.unionByName(new)


def remove(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "id", "left_anti")


def home(records: DataFrame, n: int = HOME) -> DataFrame:
    return records.filter("uri is not null").orderBy(F.desc("opened_ms"), "id").limit(n)


def category(availability: Column, status: Column) -> Column:
    return (
        F.when(availability == "PermissionLost", "PermissionLost").when(availability == "MissingDocument", "Missing").when(status == "Stale", "Stale")
        .when(status == "InProgress", "InProgress").when(status == "Available", "Indexed").otherwise("Recent")
    )


def catalog_entries(listing: DataFrame, current: int) -> DataFrame:
    """One entry per source and stream of a listing (source_key, stream_index,
    version, complete, path): of the current schema version before older ones,
    then the newest version, then the first path."""
    w = Window.partitionBy("source_key", "stream_index").orderBy((F.col("version") == current).desc(), F.desc("version"), "path")
    st = F.when(F.col("version") != current, "Stale").when(F.col("complete"), "Indexed").otherwise("InProgress")
    return listing.withColumn("status", st).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def safe_key(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9_-]{1,256}\z"), F.lit(False))


def safe_path(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & ~c.startswith("/") & ~c.contains("\\") & ~c.rlike(r"(^|/)\.{0,2}(/|$)"), F.lit(False))


def storage(files: DataFrame) -> DataFrame:
    """Bytes and files of each category, and of all under a null category."""
    return files.rollup("category").agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("files"), F.countDistinct("source_key").alias("sources"))
