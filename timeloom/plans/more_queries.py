"""Picture, store, validation and extension queries with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import pixels as px
from ..functions import timebase as tb
from ..operators import grouping as gr
from ..operators import library as li
from ..operators import pictures as pi
from ..operators import selection as sel
from ..operators import similarity as si
from ..sources import decoded, store
from . import bridge as br
from .bridge import FRAMES, GRID

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


def shared(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/timeloom-store/{uuid.uuid4().hex}"


def pictures(spark, d):
    """8 x 8 grey pictures in rows of 36 bytes, built without Python."""
    hx = lambda x: F.lpad(F.hex(x), 2, "0")
    row = lambda r: F.concat(F.array_join(F.transform(F.slice("v", r * 8 + 1, 8), lambda x: F.concat(hx(x), hx(x), hx(x), F.lit("FF"))), ""), F.lit("00000000"))
    g = br.grid(spark, d)
    return g.select("frame_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(36).alias("stride"), F.unhex(F.concat(*[row(r) for r in range(8)])).alias("pixels"))


HEX = "array_to_string(list_transform(v, lambda x: printf('%02X%02X%02XFF', x, x, x)), '')"


@query("s4_materialise", f"SELECT frame_id, {HEX} AS pixels FROM grid", GRID)
def s4(spark, d):
    return pi.tight(pictures(spark, d)).select("frame_id", F.hex("tight").alias("pixels"))


@query("g2_buffer_check", "SELECT frame_id, frame_id % 4 < 2 AS valid FROM grid", GRID)
def g2(spark, d):
    m = F.col("frame_id") % 4
    p = pictures(spark, d).withColumn("pixels", F.when(m == 3, F.unhex(F.lit("00"))).otherwise(F.col("pixels"))).withColumn("stride", F.when(m == 2, 31).otherwise(36))
    return p.select("frame_id", pi.valid(F.col("width"), F.col("height"), F.col("stride"), F.col("pixels")).alias("valid"))


@query("g3_rgb_rows", "SELECT frame_id, sha256(array_to_string(list_transform(v, lambda x: printf('%02X%02X%02X', x, x, x)), '')) AS rgb_sha256 FROM grid", GRID)
def g3(spark, d):
    return pi.rgb(pictures(spark, d)).select("frame_id", F.sha2(F.hex("rgb"), 256).alias("rgb_sha256"))


@query("g5_resample")
def g5(spark, d):
    return pi.resampled(pictures(spark, d), 16, 16).select("frame_id", F.sha2("rgb", 256).alias("rgb_sha256"))


@query("g7_descriptor_hash")
def g7(spark, d):
    return si.describe(pictures(spark, d)).select("frame_id", "difference_hash")


@query("g18_preview", "SELECT frame_id, 4 AS width, 4 AS height, array_to_string(list_transform(range(0, 16), lambda i: printf('%02X%02X%02XFF', v[(i // 4) * 16 + (i % 4) * 2 + 1], v[(i // 4) * 16 + (i % 4) * 2 + 1], v[(i // 4) * 16 + (i % 4) * 2 + 1])), '') AS pixels FROM grid", GRID)
def g18(spark, d):
    return pi.previews(pictures(spark, d), 4).select("frame_id", "width", "height", F.hex("pixels").alias("pixels"))


@query("k7_encode_png")
def k7(spark, d):
    return pi.encoded(pictures(spark, d)).select("frame_id", "bytes", F.sha2("data", 256).alias("sha256"))


def pairs(spark, d):
    """Each frame with one partner, and each frame as the partner of one, by rank."""
    g = br.grid(spark, d).select("frame_id")
    n = g.count()
    r = li.numbered(g, [F.col("frame_id")], "r").select("frame_id", F.col("r") - 1)
    # a factor that divides n would leave frames without a turn
    partner = (F.col("r") * (7 if n % 7 else 1) + 3) % max(n, 1)
    return r.toDF("target", "r").select("target", partner.alias("r")).join(r.toDF("frame_id", "r"), "r").select("target", "frame_id")


PAIRS = f"""{GRID}, places AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS r, count(*) OVER () AS n FROM grid),
pairs AS (SELECT x.frame_id AS target, y.frame_id FROM places x JOIN places y ON y.r = (x.r * CASE WHEN x.n % 7 = 0 THEN 1 ELSE 7 END + 3) % x.n)"""


@query("g11_rgb_similarity", "SELECT p.target, p.frame_id, 10000 - (3 * list_sum(list_transform(range(1, 65), lambda i: abs(x.v[i] - y.v[i])))::BIGINT * 10000 + 192 * 255 // 2) // (192 * 255) AS similarity FROM pairs p JOIN grid x ON x.frame_id = p.target JOIN grid y ON y.frame_id = p.frame_id", PAIRS)
def g11(spark, d):
    return rgb_similarity(spark, d, pairs(spark, d))


def rgb_similarity(spark, d, chosen):
    g = br.grid(spark, d)
    three = lambda c: F.concat(c, c, c)
    j = chosen.join(g, "frame_id").join(g.toDF("target", "w"), "target")
    return j.select("target", "frame_id", px.mean_absolute(three(F.col("v")), three(F.col("w")), 192).alias("similarity"))


@query("g22_exact_threshold", "SELECT p.target, p.frame_id, x.v = y.v AS same FROM pairs p JOIN grid x ON x.frame_id = p.target JOIN grid y ON y.frame_id = p.frame_id", PAIRS)
def g22(spark, d):
    return g11(spark, d).select("target", "frame_id", (F.col("similarity") == 10000).alias("same"))


@query("g13_translation")
def g13(spark, d):
    return pi.pair_scores(pairs(spark, d), br.descriptors(spark, d), px.shifted, "similarity")


@query("g14_crop_search")
def g14(spark, d):
    return pi.pair_scores(pairs(spark, d), br.descriptors(spark, d), px.cropped, "similarity")


@query("g15_confirmation")
def g15(spark, d):
    return si.confirm(pairs(spark, d), br.descriptors(spark, d))


@query("g20_viewport", "SELECT p_partkey AS id, least(1.0, 1.0 / least(1080.0::DOUBLE / w, 1920.0::DOUBLE / h)) AS minimum, least(1080.0::DOUBLE / w, 1920.0::DOUBLE / h) AS fit FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 25 AS h FROM part)")
def g20(spark, d):
    w, h = F.col("p_size") * 40, F.col("p_size") * 25
    fit = F.least(F.lit(1080.0) / w, F.lit(1920.0) / h)
    return br.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.least(F.lit(1.0), 1.0 / fit).alias("minimum"), fit.alias("fit"))


# Sources and stores

@query("s2_decode_stream", "SELECT s AS source_key, i AS frame_id, 40 * i AS ticks, i % 30 = 0 AS keyframe FROM range(3) a(s), range(500) b(i)")
def s2(spark, d):
    decoded.register(spark)
    df = spark.read.format("decoded_frames").option("frames", 500).option("sources", 3).option("framesPerTask", 200).load()
    return df.select("source_key", "frame_id", "ticks", "keyframe")


@query("k1_append_batches", "SELECT source_key, frame_id, ticks, keyframe, frame_id // 256 AS batch FROM frames", FRAMES)
def k1(spark, d):
    s = store.FrameStores(spark, shared(spark))
    s.append(br.frames(spark, d).select("source_key", "frame_id", "ticks", "keyframe"))
    return s.frames().select("source_key", "frame_id", "ticks", "keyframe", "batch")


@query("k2_truncate", "SELECT source_key, frame_id, ticks, keyframe FROM frames WHERE frame_id < 20", FRAMES)
def k2(spark, d):
    s = store.FrameStores(spark, shared(spark))
    s.append(br.frames(spark, d).select("source_key", "frame_id", "ticks", "keyframe"))
    s.truncate(20)
    return s.frames().select("source_key", "frame_id", "ticks", "keyframe")


SOURCES = f"{FRAMES}, sources AS (SELECT source_key, count(*) AS n FROM frames GROUP BY 1)"


@query("s6_open_dispositions", """SELECT source_key, CASE source_key % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'rebuilt-version' WHEN 2 THEN 'rebuilt-identity' WHEN 3 THEN 'rebuilt-version' WHEN 4 THEN 'recovered' ELSE 'reused' END AS disposition,
    CASE WHEN source_key % 6 >= 4 THEN n ELSE 0 END AS indexed_frames FROM sources""", SOURCES)
def s6(spark, d):
    n = br.frames(spark, d).groupBy("source_key").agg(F.count("*").alias("n"))
    k = F.col("source_key") % 6
    # none stored; an old version; another identity; both; still building; complete
    stored = n.filter(k != 0).select(
        F.col("source_key").cast("string"), F.when(k.isin(1, 3), store.VERSION - 1).otherwise(store.VERSION).alias("version"), F.when(k == 4, "building").otherwise("complete").alias("lifecycle"),
        F.concat(F.lit("sha256:"), F.when(k.isin(2, 3), "old").otherwise("own")).alias("identity"), F.col("n").alias("indexed_frames"), F.col("n").alias("frame_count"), F.lit(1).cast("long").alias("generation"),
    )
    wanted = n.select(F.col("source_key").cast("string"), F.lit("sha256:own").alias("identity"))
    return store.dispositions(stored, wanted).select(F.col("source_key").cast("long"), "disposition", "indexed_frames")


@query("k3_lifecycle", "SELECT source_key, CASE source_key % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'failed' END AS lifecycle, n AS indexed_frames, CASE WHEN source_key % 3 = 0 THEN n END AS frame_count FROM sources", SOURCES)
def k3(spark, d):
    s = store.FrameStores(spark, shared(spark))
    s.append(br.frames(spark, d).select("source_key", "frame_id"))
    for k, lifecycle in enumerate(("complete", "incomplete", "failed")):
        s.mark(lifecycle, F.col("source_key").cast("long") % 3 == k)
    return s.meta().select(F.col("source_key").cast("long"), "lifecycle", "indexed_frames", "frame_count")


RUNS = """ru AS (SELECT *, value IS DISTINCT FROM lag(value) OVER w OR lag(frame_id) OVER w IS NULL AS ch FROM frames WINDOW w AS (PARTITION BY source_key ORDER BY frame_id)),
rn AS (SELECT *, (sum(ch::INT) OVER (PARTITION BY source_key ORDER BY frame_id) - 1)::BIGINT AS ordinal FROM ru),
runs AS (SELECT source_key, ordinal, min(frame_id) AS first, max(frame_id) AS last, count(*) AS frames, min(frame_id) AS representative FROM rn GROUP BY 1, 2)"""


def _groups(spark, d):
    f = br.frames(spark, d)
    n = f.groupBy("source_key").agg(F.count("*").alias("n"))
    return store.open_or_build(spark, shared(spark), lambda g: not gr.group_faults(g, n).limit(1).count(), lambda: gr.exact_runs(f, "value"))[0]


@query("st5_open_or_build_groups", "SELECT source_key, ordinal, first, last FROM runs", f"{FRAMES}, {RUNS}")
def st5(spark, d):
    return _groups(spark, d).select("source_key", "ordinal", "first", "last")


@query("s7_read_groups", "SELECT source_key, count(*) AS groups, sum(frames)::BIGINT AS frames FROM runs GROUP BY 1", f"{FRAMES}, {RUNS}")
def s7(spark, d):
    return _groups(spark, d).groupBy("source_key").agg(F.count("*").alias("groups"), F.sum("frames").alias("frames"))


@query("k4_publish", "SELECT source_key, max(ordinal) AS last_group FROM runs GROUP BY 1", f"{FRAMES}, {RUNS}")
def k4(spark, d):
    path = shared(spark)
    store.publish(gr.exact_runs(br.frames(spark, d), "value"), path)
    return spark.read.parquet(path).groupBy("source_key").agg(F.max("ordinal").alias("last_group"))


@query("s8_descriptor_store", "SELECT count(*) AS descriptors, count(*) * 9 AS keys FROM grid", GRID)
def s8(spark, d):
    x, _ = store.open_or_build(spark, shared(spark), lambda g: not si.incomplete(si.keys(g)).limit(1).count(), lambda: br.descriptors(spark, d))
    return si.keys(x).agg(F.countDistinct("frame_id").alias("descriptors"), F.count("*").alias("keys"))


@query("s10_progressive_layers", """SELECT source_key, layer, CASE WHEN layer = 1 THEN 'complete' WHEN n % 2 = 0 THEN 'partial' ELSE 'missing' END AS lifecycle FROM (SELECT source_key, count(*) AS n FROM frames GROUP BY 1), range(1, 4) t(layer)""", FRAMES)
def s10(spark, d):
    n = br.frames(spark, d).groupBy("source_key").agg(F.count("*").alias("n"))
    each = n.withColumn("layer", F.explode(F.expr("array(1L, 2L, 3L)")))
    return each.select("source_key", "layer", F.when(F.col("layer") == 1, "complete").when(F.col("n") % 2 == 0, "partial").otherwise("missing").alias("lifecycle"))


@query("k12_export_transaction", "SELECT source_key, CASE WHEN bad > 0 THEN 'deleted' ELSE 'committed' END AS outcome FROM (SELECT source_key, sum(corrupt::INT) AS bad FROM frames WHERE frame_id % 4 = 0 GROUP BY 1)", FRAMES)
def k12(spark, d):
    f = br.frames(spark, d)
    x = sel.execute(f, sel.plan(f, sel.Request("all", every_n=4)))
    return x.groupBy("source_key").agg(F.when(F.bool_or("corrupt"), "deleted").otherwise("committed").alias("outcome"))


@query("k15_layer_progress", "SELECT o_orderkey AS id, g > 0 AND c <= t AND (l <> 'complete' OR t = c) AS allowed FROM (SELECT o_orderkey, o_orderkey % 5 AS g, o_orderkey % 7 AS c, o_orderkey % 11 AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'complete' ELSE 'building' END AS l FROM orders)")
def k15(spark, d):
    k = F.col("o_orderkey")
    return br.read(spark, d, "orders").select(k.alias("id"), checks.progress(F.when(k % 2 == 0, "complete").otherwise("building"), k % 7, k % 11, k % 5).alias("allowed"))


@query("k5_group_rows", "SELECT source_key, ordinal // 128 AS batch, count(*) AS rows FROM runs GROUP BY 1, 2", f"{FRAMES}, {RUNS}")
def k5(spark, d):
    return gr.exact_runs(br.frames(spark, d), "value").groupBy("source_key", F.expr("ordinal div 128").alias("batch")).agg(F.count("*").alias("rows"))


# Validation and identity

@query("p3_time_base_guard", "SELECT source_key, count(ticks) AS timed FROM frames GROUP BY 1", FRAMES)
def p3(spark, d):
    f = br.frames(spark, d).withColumn("ticks", checks.same_time_base(F.lit(3600), F.lit(1), 3600, 1, F.col("ticks")))
    return f.groupBy("source_key").agg(F.count("ticks").alias("timed"))


@query("p10_artifact_rows", "SELECT l_orderkey, l_linenumber, (l_linenumber % 3 > 0 OR l_orderkey % 2 = 0) AND l_quantity > 5 AND l_partkey % 4 > 0 AND l_linenumber % 5 <> 2 AS valid FROM lineitem")
def p10(spark, d):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    key = F.when(n % 5 == 2, "../up").otherwise(F.concat(F.lit("v/"), o, F.lit(".png")))
    ok = checks.artifact(F.when(n % 3 > 0, n), F.when(o % 2 == 0, o), F.col("l_quantity") - 5, F.lit(1), F.col("l_partkey") % 4, li.safe_path(key))
    return br.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("valid"))


@query("p13_policies", "SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, true)) t(id, valid)")
def p13(spark, d):
    tries = ({}, {"max_distance": 65}, {"least": 10001}, {"cap": 0}, {"max_distance": 64, "least": 0})
    out = []
    for k, args in enumerate(tries):
        try:
            checks.similarity_policy(**args)
            out.append((k, True))
        except checks.PolicyError:
            out.append((k, False))
    return spark.createDataFrame(out, "id int, valid boolean")


@query("j12_identity_gate", "SELECT a.c_custkey AS id FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey AND (CASE WHEN a.c_custkey % 4 > 0 THEN a.c_nationkey END) IS NOT DISTINCT FROM (CASE WHEN b.c_custkey % 4 > 0 THEN b.c_nationkey + (b.c_custkey % 3 = 0)::INT END)")
def j12(spark, d):
    c = br.read(spark, d, "customer")
    k = F.col("c_custkey")
    a = c.select(k.alias("id"), F.when(k % 4 > 0, F.col("c_nationkey")).alias("x"))
    b = c.select(k.alias("id"), F.when(k % 4 > 0, F.col("c_nationkey") + F.when(k % 3 == 0, 1).otherwise(0)).alias("y"))
    return a.join(b, "id").filter(F.col("x").eqNullSafe(F.col("y"))).select("id")


@query("f3_container_duration", "SELECT o_orderkey AS id, (o_orderkey::HUGEINT * 1000000 // 90000)::BIGINT AS us FROM orders")
def f3(spark, d):
    return br.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tb.us_of(F.col("o_orderkey").cast("long"), 1, 90000).alias("us"))


@query("n2_namespaced_paths", "SELECT c_custkey AS id, 'similarity/' || c_custkey || '/stream-' || c_nationkey || '-hybrid-h8-l9700' AS path FROM customer")
def n2(spark, d):
    return br.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("similarity/"), "c_custkey", F.lit("/stream-"), "c_nationkey", F.lit("-hybrid-h8-l9700")).alias("path"))


@query("st7_progress_publication", "SELECT source_key, max(sequence) AS sequence, sequence // 64 AS step FROM (SELECT user_id::BIGINT AS source_key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence FROM events) GROUP BY 1, 3")
def st7(spark, d):
    s = br.samples(spark, d)
    return s.groupBy("source_key", F.expr("sequence div 64").alias("step")).agg(F.max("sequence").alias("sequence"))


@query("st15_generation_fence", "SELECT event_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 7 AS generation FROM events) QUALIFY generation = max(generation) OVER (PARTITION BY user_id)")
def st15(spark, d):
    w = Window.partitionBy("user_id")
    e = br.read(spark, d, "events").select("event_id", "user_id", F.expr("row_number() over (partition by user_id order by event_id) div 7").alias("generation"))
    return e.withColumn("current", F.max("generation").over(w)).filter("generation = current").select("event_id")
