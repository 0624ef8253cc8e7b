"""The driver's tables in the shapes of the operators, and the same as SQL.

Frames come from ``events`` (a source per user, an hour's ticks), luma grids from
``embeddings``, the library and its catalog from ``customer`` and ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    # wall-clock microseconds of a timestamp without time zone, whatever the session's zone is
    us = F.expr(
        "cast(unix_date(cast(ts as date)) as bigint) * 86400000000 + (hour(ts) * 3600L + minute(ts) * 60L) * 1000000L"
        " + cast(extract(second from ts) * 1000000 as bigint)"
    )
    return e.select("event_id", "user_id", "event_type", "value", us.cast("long").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").cast("long").alias("source_key"), (F.row_number().over(w) - 1).cast("long").alias("frame_id"),
        F.when(F.col("event_type") != "error", F.expr(f"us div {HOUR_US}")).alias("ticks"),
        F.when((F.col("event_type") != "view") & (F.col("k") > 0), F.col("k")).alias("duration_ticks"),
        (F.col("event_type") == "purchase").alias("keyframe"), F.coalesce(F.col("k") % 7 == 0, F.lit(False)).alias("corrupt"),
        (F.coalesce("k", F.lit(0)) % 3).alias("value"), (F.coalesce("k", F.lit(0)) * 2).alias("luma"), "event_id",
    )


FRAMES = f"""f0 AS (SELECT user_id, event_id, event_type, value AS val, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
frames AS (SELECT user_id::BIGINT AS source_key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_id,
  CASE WHEN event_type <> 'error' THEN us // {HOUR_US} END AS ticks, CASE WHEN event_type <> 'view' AND k > 0 THEN k END AS duration_ticks,
  event_type = 'purchase' AS keyframe, coalesce(k % 7 = 0, false) AS corrupt, coalesce(k, 0) % 3 AS value, coalesce(k, 0) * 2 AS luma, event_id FROM f0)"""


def probes(f: DataFrame, n: int = 10) -> DataFrame:
    """Evenly spaced times per source, from before its first to after its last."""
    r = f.groupBy("source_key").agg((F.min("ticks") - 1).alias("lo"), (F.max("ticks") + 1).alias("hi")).filter("lo is not null")
    p = r.withColumn("probe_no", F.explode(F.expr(f"sequence(0L, {n - 1}L)")))
    return p.select("source_key", "probe_no", F.expr(f"lo + probe_no * (hi - lo) div {n - 1}").alias("target"))


PROBES = """pr AS (SELECT source_key, min(ticks) - 1 AS lo, max(ticks) + 1 AS hi FROM frames GROUP BY source_key),
probes AS (SELECT source_key, i AS probe_no, lo + i * (hi - lo) // 9 AS target FROM pr, range(10) t(i) WHERE lo IS NOT NULL)"""

ANCHORED = """anchored AS (SELECT *, max(CASE WHEN keyframe AND NOT corrupt THEN frame_id END) OVER (PARTITION BY source_key ORDER BY frame_id) AS anchor_frame FROM frames)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1.0) * 127.5))).cast("long"))
    return e.select(F.col("vec_id").alias("frame_id"), v.alias("v"))


GRID = """grid AS (SELECT vec_id AS frame_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1.0) * 127.5)))::BIGINT) AS v FROM embeddings)"""


def spread(rows: DataFrame) -> DataFrame:
    """Few bytes of one file, that much is made of, over all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Each grid as a grey picture of 8 x 8, described."""
    from ..operators import similarity

    rows = spread(grid(spark, d))

    def pixels(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            v = b.column("v").flatten().to_numpy().astype(np.uint8).reshape(n, 64, 1)
            out = [x.tobytes() for x in np.concatenate([v, v, v, np.full_like(v, 255)], axis=2)]
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), *(pa.array([x] * n, pa.int32()) for x in (8, 8, 32)), pa.array(out, pa.binary())], ["frame_id", "width", "height", "stride", "pixels"])

    img = rows.mapInArrow(pixels, "frame_id long, width int, height int, stride int, pixels binary")
    return similarity.with_bucket(similarity.describe(img))


def access_log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.expr("event_id div 500").alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").cast("long").alias("key"), (F.col("user_id") % 9 + 1).cast("long").alias("size"))


LOG = "log AS (SELECT event_id // 500 AS cache, event_id AS seq, user_id::BIGINT AS key, (user_id % 9 + 1)::BIGINT AS size FROM events)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return e.select(
        F.col("user_id").cast("long").alias("source_key"), (F.row_number().over(w) - 1).cast("long").alias("sequence"), F.col("event_type").alias("stage"),
        F.sum((F.col("event_type") != "view").cast("long")).over(upto).alias("indexed_frames"), (F.col("event_type") == "error").alias("is_rebuild"),
        F.col("us").alias("current_us"), F.expr("us div 1000").alias("elapsed_ms"), "event_id",
    )


SAMPLES = """s0 AS (SELECT user_id::BIGINT AS source_key, row_number() OVER w - 1 AS sequence, event_type AS stage,
  (sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER w)::BIGINT AS indexed_frames, event_type = 'error' AS is_rebuild, epoch_us(ts) AS current_us,
  epoch_us(ts) // 1000 AS elapsed_ms, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
samples AS (SELECT * FROM s0)"""


def library(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("content://m/"), "c_custkey")).alias("uri"),
        (F.col("c_custkey") * 7919 % 1000003).cast("long").alias("opened_ms"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("source_key"),
        F.lit(0).alias("stream_index"),
    )


def catalog(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.select(
        F.col("o_custkey").cast("string").alias("source_key"), F.lit(0).alias("stream_index"),
        F.when(F.col("n") % 3 == 0, "Stale").when(F.col("n") % 3 == 1, "InProgress").otherwise("Available").alias("status"),
        F.when(F.col("n") % 3 != 1, F.col("n")).alias("frame_count"), F.col("n").alias("indexed_frames"), (F.col("n") * 100003).alias("modified_ms"),
    )


LIBRARY = """library AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN 'content://m/' || c_custkey END AS uri,
  (c_custkey * 7919 % 1000003)::BIGINT AS opened_ms, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END AS source_key, 0 AS stream_index FROM customer),
oc AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
catalog AS (SELECT o_custkey::VARCHAR AS source_key, 0 AS stream_index, CASE n % 3 WHEN 0 THEN 'Stale' WHEN 1 THEN 'InProgress' ELSE 'Available' END AS status,
  CASE WHEN n % 3 <> 1 THEN n END AS frame_count, n AS indexed_frames, n * 100003 AS modified_ms FROM oc),
reconciled AS (SELECT l.id, l.uri, l.opened_ms, l.source_key, l.stream_index, CASE WHEN l.source_key IS NULL THEN 'Unknown' ELSE coalesce(c.status, 'Missing') END AS status,
    coalesce(c.frame_count, c.indexed_frames) AS frames, c.modified_ms FROM library l LEFT JOIN catalog c ON c.source_key = l.source_key AND c.stream_index = l.stream_index
  UNION ALL SELECT 'index:' || c.source_key || ':' || c.stream_index, NULL, 0, c.source_key, c.stream_index, c.status, coalesce(c.frame_count, c.indexed_frames), c.modified_ms
  FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM library l WHERE l.source_key = c.source_key AND l.stream_index = c.stream_index))"""
