"""Queries of sessions and storage with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import sessions as se
from ..operators import timeline as tl
from . import bridge as br
from .bridge import ANCHORED, FRAMES, PROBES

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str, ctes: str = ""):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


# Where the text is the same in both dialects, it is written once.
STREAMS = """l_orderkey AS source_key, cast(l_linenumber - 1 AS BIGINT) AS stream_index, CASE WHEN l_partkey % 3 = 0 OR l_orderkey % 11 = 0 THEN 'audio' ELSE 'video' END AS kind,
    l_suppkey % 4 > 0 AND l_orderkey % 13 > 0 AS decodable, l_quantity > 40 AS is_default, CASE WHEN l_orderkey % 4 = 1 THEN cast(l_orderkey % 5 AS BIGINT) END AS requested"""


def columns(text: str) -> list[str]:
    """The items of a select list without commas inside parentheses or functions."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out, item = [*out, item], ""
        else:
            item += c
    return [x.strip() for x in [*out, item]]


@query("s3_stream_selection", """SELECT source_key, coalesce(CASE WHEN wish IS NULL THEN d ELSE w END, CASE WHEN wish IS NULL THEN s END) AS stream_index,
    CASE WHEN wish IS NOT NULL AND w IS NULL AND nw = 0 THEN 'no_video_stream' WHEN wish IS NOT NULL AND w IS NULL THEN 'unsupported_codec' WHEN wish IS NULL AND s IS NULL AND nv = 0 THEN 'no_video_stream' WHEN wish IS NULL AND s IS NULL THEN 'unsupported_codec' END AS error
    FROM (SELECT source_key, any_value(requested) AS wish, count(*) FILTER (kind = 'video') AS nv, count(*) FILTER (kind = 'video' AND stream_index = requested) AS nw,
      min(stream_index) FILTER (kind = 'video' AND decodable AND stream_index = requested) AS w, min(stream_index) FILTER (kind = 'video' AND decodable AND is_default) AS d,
      min(stream_index) FILTER (kind = 'video' AND decodable) AS s FROM streams GROUP BY 1)""", f"streams AS (SELECT {STREAMS} FROM lineitem)")
def s3(spark, d):
    return se.select_streams(br.read(spark, d, "lineitem").selectExpr(*columns(STREAMS)))


TARGET = "CASE WHEN probe_no % 4 = 2 THEN -1 - probe_no ELSE target END"


@query("s5_seek", """SELECT source_key, probe_no, target, CASE WHEN target >= 0 THEN coalesce(landing, 0) END AS landing, CASE WHEN target >= 0 THEN sum((target >= 0)::INT) OVER (PARTITION BY source_key ORDER BY probe_no)::BIGINT END AS epoch,
    CASE WHEN target < 0 THEN 'seek_unavailable' END AS error
    FROM (SELECT p.source_key, p.probe_no, p.target, arg_max(f.frame_id, (f.ticks, f.frame_id)) AS landing FROM asked p LEFT JOIN frames f ON f.source_key = p.source_key AND f.ticks <= p.target AND f.keyframe AND NOT f.corrupt GROUP BY ALL)""",
       f"{FRAMES}, {PROBES}, asked AS (SELECT source_key, probe_no, {TARGET} AS target FROM probes)")
def s5(spark, d):
    f = br.frames(spark, d)
    return se.seek(f, br.probes(f).withColumn("target", F.expr(TARGET)))


DECODED = """source_key, frame_id + CASE WHEN source_key % 7 = 5 AND frame_id >= 6 THEN 1 ELSE 0 END AS frame_id, frame_id AS position, ticks,
    CASE WHEN source_key % 7 = 2 AND frame_id = 3 THEN 77 ELSE duration_ticks END AS duration_ticks, keyframe, corrupt, 11 AS width, CASE WHEN source_key % 7 = 3 AND frame_id >= 4 THEN 8 ELSE 9 END AS height"""
CUT = "(source_key % 7 <> 1 OR frame_id < 5)"
EXTRA = "source_key % 7 = 4 AND frame_id < 2"
LATER = "source_key, frame_id + 1000000 AS frame_id, frame_id + 1000000 AS position, ticks, duration_ticks, keyframe, corrupt, 11 AS width, 9 AS height"
SAME = ("ticks", "duration_ticks", "keyframe", "corrupt")


@query("s12_frame_stream", """SELECT source_key, min(position) AS agreed, arg_min(fault, position) AS fault FROM (SELECT coalesce(i.source_key, d.source_key) AS source_key, coalesce(i.frame_id, d.position) AS position,
    CASE WHEN d.position IS NULL THEN 'early end' WHEN i.frame_id IS NULL THEN 'more frames' WHEN d.frame_id <> i.frame_id THEN 'sequence'
      WHEN d.ticks IS DISTINCT FROM i.ticks OR d.duration_ticks IS DISTINCT FROM i.duration_ticks OR d.keyframe <> i.keyframe OR d.corrupt <> i.corrupt THEN 'timeline' WHEN d.width <> 11 OR d.height <> 9 THEN 'dimensions' END AS fault
    FROM frames i FULL JOIN decoded d ON d.source_key = i.source_key AND d.position = i.frame_id) WHERE fault IS NOT NULL GROUP BY 1""",
       f"{FRAMES}, decoded AS (SELECT {DECODED} FROM frames WHERE {CUT} UNION ALL SELECT {LATER} FROM frames WHERE {EXTRA})")
def s12(spark, d):
    f = br.frames(spark, d)
    got = f.filter(CUT).selectExpr(*columns(DECODED)).union(f.filter(EXTRA).selectExpr(*columns(LATER)))
    return se.stream_faults(f.withColumns({"width": F.lit(11), "height": F.lit(9)}), got, SAME)


ASKED = "source_key, frame_id AS seq, cast(floor(frame_id / 2) AS BIGINT) * 3 % n AS wanted, CASE WHEN frame_id % 17 = 3 THEN 1 ELSE 0 END AS reopens"


@query("a11_navigation", """SELECT source_key, count(*) AS requested, count(*) FILTER (seeks) AS random_seeks, count(*) FILTER (reopens = 0 AND decoded > 0 AND NOT seeks) AS warm_hits, count(*) FILTER (reopens = 0 AND decoded = 0) AS ram_hits,
    coalesce(sum(decoded) FILTER (reopens = 0 AND decoded > 0 AND NOT seeks), 0)::BIGINT AS forward_decodes, sum(reopens)::BIGINT AS reopened, sum(decoded)::BIGINT AS decoded_frames, sum(distance)::BIGINT AS seek_frames,
    arg_max(distance, seq) AS last_distance, arg_max(decoded, seq) AS last_decoded, arg_max(seeks, seq) AS last_seeks FROM (SELECT *, CASE WHEN seeks THEN wanted - start ELSE 0 END AS distance, CASE WHEN seeks THEN wanted - start + 1 ELSE wanted - "at" END AS decoded
    FROM (SELECT *, "at" IS NULL OR "at" > wanted OR ("at" < wanted AND start > "at") AS seeks FROM (SELECT a.source_key, a.seq, a.wanted, a.reopens, coalesce(k.anchor_frame, 0) AS start,
      CASE WHEN a.reopens = 0 THEN lag(a.wanted) OVER (PARTITION BY a.source_key ORDER BY a.seq) END AS "at" FROM asked a JOIN anchored k ON k.source_key = a.source_key AND k.frame_id = a.wanted))) GROUP BY 1""",
       f"{FRAMES}, {ANCHORED}, asked AS (SELECT {ASKED} FROM frames JOIN (SELECT source_key, count(*) AS n FROM frames GROUP BY 1) USING (source_key))")
def a11(spark, d):
    f = br.frames(spark, d)
    asked = f.join(f.groupBy("source_key").agg(F.count("*").alias("n")), "source_key").selectExpr(*columns(ASKED)).withColumnRenamed("wanted", "frame_id")
    return se.navigation_diagnostics(se.presentations(asked.join(tl.anchors(f).select("source_key", "frame_id", "anchor_frame"), ["source_key", "frame_id"])))


FILES = """CASE WHEN l_orderkey % 3 = 0 THEN 'index' WHEN l_orderkey % 3 = 1 THEN 'preview' ELSE 'other' END AS category, concat('k', l_suppkey) AS source_key, cast(l_quantity * 1000 AS BIGINT) AS bytes"""
CLEARS = """c_custkey AS request, CASE WHEN c_custkey % 7 = 0 THEN 'index' WHEN c_custkey % 7 = 1 THEN 'preview' WHEN c_custkey % 7 = 2 THEN 'other' WHEN c_custkey % 7 = 3 THEN 'all' ELSE 'source' END AS scope,
    CASE WHEN c_custkey % 7 = 4 THEN concat('../k', c_custkey) WHEN c_custkey % 7 > 4 THEN concat('k', c_custkey) END AS source_key"""


@query("k16_clear", """SELECT request, CASE WHEN bad THEN 'invalid_source_key' END AS error, CASE WHEN NOT bad THEN count(category) END AS files, CASE WHEN NOT bad THEN coalesce(sum(bytes), 0)::BIGINT END AS bytes
    FROM (SELECT request, scope, source_key, scope = 'source' AND NOT regexp_full_match(source_key, '[A-Za-z0-9_-]{1,256}') AS bad FROM clears) r
    LEFT JOIN files f ON NOT bad AND (r.scope = 'all' OR r.scope = f.category OR (r.scope = 'source' AND f.category = 'index' AND f.source_key = r.source_key)) GROUP BY request, bad""",
       f"files AS (SELECT {FILES} FROM lineitem), clears AS (SELECT {CLEARS} FROM customer)")
def k16(spark, d):
    files = br.read(spark, d, "lineitem").selectExpr(*columns(FILES))
    return se.clear_reports(files, br.read(spark, d, "customer").selectExpr(*columns(CLEARS)))


CACHED = "l_suppkey AS cache, concat(l_orderkey, '-', l_linenumber) AS name, cast(l_quantity * 1000 AS BIGINT) AS bytes, l_shipdate AS modified, l_partkey % 9 = 0 AS temporary"


@query("k18_cache_open", """SELECT cache, count(*) FILTER (temporary) AS temporary_removed, count(*) FILTER (stays) AS resident_files, coalesce(sum(bytes) FILTER (stays), 0)::BIGINT AS resident_bytes, count(*) FILTER (NOT temporary AND NOT stays) AS evictions
    FROM (SELECT *, NOT temporary AND sum(CASE WHEN temporary THEN 0 ELSE bytes END) OVER (PARTITION BY cache ORDER BY modified DESC, name DESC ROWS UNBOUNDED PRECEDING) <= 400000 AS stays FROM cached) GROUP BY 1""", f"cached AS (SELECT {CACHED} FROM lineitem)")
def k18(spark, d):
    return se.open_caches(br.read(spark, d, "lineitem").selectExpr(*columns(CACHED)), 400_000)


SELECTIONS = """o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'current' WHEN o_orderkey % 5 = 1 THEN 'frames' WHEN o_orderkey % 5 = 2 THEN 'times' WHEN o_orderkey % 5 = 3 THEN 'all' ELSE 'representatives' END AS kind,
    o_orderkey % 12 AS first_one, o_orderkey % 13 AS last_one, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderkey % 3 END AS every_n"""


@query("p9_selection_validation", """SELECT id, CASE WHEN kind IN ('frames', 'times') AND first_one > last_one THEN kind || ' are reversed' WHEN kind IN ('frames', 'times', 'all') AND (every_n IS NULL OR every_n <= 0) THEN 'interval isn''t positive' END AS fault FROM x""", f"x AS (SELECT {SELECTIONS} FROM orders)")
def p9(spark, d):
    x = br.read(spark, d, "orders").selectExpr(*columns(SELECTIONS))
    return x.select("id", checks.selection_fault(F.col("kind"), F.col("first_one"), F.col("last_one"), F.col("every_n")).alias("fault"))


CODECS = """p_partkey AS position, concat('codec', p_partkey) AS name, concat('video/', p_partkey % 6) AS mime, CASE WHEN p_partkey % 8 = 1 THEN 28 ELSE 30 END AS sdk, p_partkey % 5 > 0 AS hardware, p_partkey % 5 = 0 AS software,
    CASE WHEN p_partkey % 4 = 1 THEN true WHEN p_partkey % 4 = 2 THEN false END AS alias, p_size > 25 AS gives_buffers"""


@query("p12_decoder_choice", """SELECT lower(w.mime) AS mime, w.buffers, (SELECT arg_min(name, position) FROM codecs c WHERE c.mime = lower(w.mime) AND sdk >= 29 AND NOT software AND hardware AND coalesce(NOT alias, true) AND (NOT w.buffers OR gives_buffers)) AS decoder FROM wanted w""",
       f"codecs AS (SELECT {CODECS} FROM part), wanted AS (SELECT 'VIDEO/' || i AS mime, i % 2 = 1 AS buffers FROM range(8) t(i))")
def p12(spark, d):
    c = br.read(spark, d, "part").selectExpr(*columns(CODECS))
    kind = checks.decoder_class(F.col("sdk"), F.col("hardware"), F.col("software"))
    wanted = spark.range(8).select(F.concat(F.lit("VIDEO/"), "id").alias("mime"), (F.col("id") % 2 == 1).alias("buffers"))
    return se.choose_decoders(c.withColumn("acceleration", kind), wanted)
