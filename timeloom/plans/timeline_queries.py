"""Timeline, selection and grouping queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timebase as tb
from ..operators import grouping as gr
from ..operators import selection as sel
from ..operators import timeline as tl
from . import bridge as br
from .bridge import ANCHORED, FRAMES, PROBES

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, ctes: str = FRAMES, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {sql}" if ctes else sql
        return f

    return add


FP = f"{FRAMES}, {PROBES}"
FA = f"{FRAMES}, {ANCHORED}, anch AS (SELECT a.*, k.ticks AS anchor_ticks FROM anchored a LEFT JOIN frames k ON k.source_key = a.source_key AND k.frame_id = a.anchor_frame)"


@query("j1_lookup", "SELECT source_key, frame_id, ticks FROM frames WHERE frame_id = 3 OR frame_id = 10")
def j1(spark, d):
    f = br.frames(spark, d)
    wanted = f.select("source_key").distinct().withColumn("frame_id", F.explode(F.expr("array(3L, 10L)")))
    return tl.lookup(f, wanted).select("source_key", "frame_id", "ticks")


@query("j2_asof_before", """SELECT p.source_key, p.probe_no, p.target, arg_max(f.frame_id, (f.ticks, f.frame_id)) AS found FROM probes p
    LEFT JOIN frames f ON f.source_key = p.source_key AND f.ticks <= p.target GROUP BY ALL""", FP)
def j2(spark, d):
    f = br.frames(spark, d)
    return tl.asof(f, br.probes(f), "before").drop("found_ticks")


@query("j3_asof_after", """SELECT p.source_key, p.probe_no, p.target, arg_min(f.frame_id, (f.ticks, f.frame_id)) AS found FROM probes p
    LEFT JOIN frames f ON f.source_key = p.source_key AND f.ticks >= p.target GROUP BY ALL""", FP)
def j3(spark, d):
    f = br.frames(spark, d)
    return tl.asof(f, br.probes(f), "after").drop("found_ticks")


NEAREST = """nf AS (SELECT p.source_key, p.probe_no, p.target, f.frame_id, row_number() OVER (PARTITION BY p.source_key, p.probe_no
    ORDER BY abs(f.ticks - p.target), f.ticks, CASE WHEN f.ticks >= p.target THEN f.frame_id ELSE -f.frame_id END) AS rn
    FROM probes p JOIN frames f ON f.source_key = p.source_key AND f.ticks IS NOT NULL)"""


@query("j4_nearest", "SELECT source_key, probe_no, target, frame_id AS found FROM nf WHERE rn = 1", f"{FP}, {NEAREST}")
def j4(spark, d):
    f = br.frames(spark, d)
    return tl.nearest(f, br.probes(f))


@query("j16_navigate", "SELECT n.source_key, n.probe_no, n.frame_id, f.keyframe, f.corrupt FROM nf n JOIN frames f USING (source_key, frame_id) WHERE rn = 1", f"{FP}, {NEAREST}")
def j16(spark, d):
    f = br.frames(spark, d)
    hit = tl.nearest(f, br.probes(f)).select("source_key", "probe_no", F.col("found").alias("frame_id"))
    return tl.lookup(f, hit).select("source_key", "probe_no", "frame_id", "keyframe", "corrupt")


DECODED = """decoded AS (SELECT source_key, frame_id, ticks, CASE WHEN frame_id % 11 = 0 THEN 1 ELSE duration_ticks END AS duration_ticks, keyframe,
    CASE WHEN frame_id % 13 = 0 THEN NOT corrupt ELSE corrupt END AS corrupt FROM frames WHERE frame_id % 17 <> 3)"""


def decoded(f: DataFrame) -> DataFrame:
    return f.filter("frame_id % 17 <> 3").withColumns({
        "duration_ticks": F.when(F.col("frame_id") % 11 == 0, F.lit(1).cast("long")).otherwise(F.col("duration_ticks")),
        "corrupt": F.when(F.col("frame_id") % 13 == 0, ~F.col("corrupt")).otherwise(F.col("corrupt")),
    })


RECONCILED = """rec AS (SELECT coalesce(i.source_key, x.source_key) AS source_key, coalesce(i.frame_id, x.frame_id) AS frame_id,
    CASE WHEN i.frame_id IS NULL THEN 'extra' WHEN x.frame_id IS NULL THEN 'missing' WHEN i.ticks IS DISTINCT FROM x.ticks THEN 'ticks'
    WHEN i.duration_ticks IS DISTINCT FROM x.duration_ticks THEN 'duration_ticks' WHEN i.keyframe IS DISTINCT FROM x.keyframe THEN 'keyframe'
    WHEN i.corrupt IS DISTINCT FROM x.corrupt THEN 'corrupt' END AS difference
    FROM frames i FULL JOIN decoded x ON x.source_key = i.source_key AND x.frame_id = i.frame_id)"""


@query("j5_reconcile", "SELECT * FROM rec WHERE difference IS NOT NULL", f"{FRAMES}, {DECODED}, {RECONCILED}")
def j5(spark, d):
    f = br.frames(spark, d)
    return tl.reconcile(f, decoded(f))


@query("st6_resume_prefix", """SELECT n.source_key, coalesce(b.bad, n.n) AS valid_prefix, CASE WHEN b.bad IS NULL THEN 'append' ELSE 'rebuild' END AS action,
    greatest(coalesce(m.m, 0) - CASE WHEN b.bad IS NULL THEN n.n ELSE 0 END, 0) AS to_write
    FROM (SELECT source_key, count(*) AS n FROM frames GROUP BY 1) n LEFT JOIN (SELECT source_key, min(frame_id) AS bad FROM rec WHERE difference IS NOT NULL AND difference <> 'extra' GROUP BY 1) b USING (source_key)
    LEFT JOIN (SELECT source_key, count(*) AS m FROM decoded GROUP BY 1) m USING (source_key)""", f"{FRAMES}, {DECODED}, {RECONCILED}")
def st6(spark, d):
    f = br.frames(spark, d)
    return tl.prefix_match(f, decoded(f))


@query("w3_anchors", "SELECT source_key, frame_id, anchor_frame, anchor_ticks FROM anch", FA)
def w3(spark, d):
    return tl.anchors(br.frames(spark, d)).select("source_key", "frame_id", "anchor_frame", "anchor_ticks")


@query("j14_nearest_keyframe", "SELECT source_key, frame_id, coalesce(anchor_frame, 0) AS decode_from FROM anch", FA)
def j14(spark, d):
    return tl.anchors(br.frames(spark, d)).select("source_key", "frame_id", F.coalesce("anchor_frame", F.lit(0)).cast("long").alias("decode_from"))


@query("j6_anchor_check", """SELECT b.source_key, b.frame_id, b.anchor_frame FROM (SELECT source_key, frame_id, CASE WHEN frame_id % 7 = 5 THEN anchor_frame + 1 ELSE anchor_frame END AS anchor_frame, anchor_ticks FROM anch) b
    LEFT JOIN frames k ON k.source_key = b.source_key AND k.frame_id = b.anchor_frame
    WHERE b.anchor_frame IS NOT NULL AND (NOT coalesce(k.keyframe AND NOT k.corrupt, false) OR k.ticks IS DISTINCT FROM b.anchor_ticks)""", FA)
def j6(spark, d):
    a = tl.anchors(br.frames(spark, d))
    return tl.bad_anchors(a.withColumn("anchor_frame", F.when(F.col("frame_id") % 7 == 5, F.col("anchor_frame") + 1).otherwise(F.col("anchor_frame"))))


GOPS = """gops AS (SELECT k.source_key, row_number() OVER w - 1 AS ordinal, frame_id AS first, coalesce(lead(frame_id) OVER w, n.n) AS "end", ticks AS start_ticks, lead(ticks) OVER w AS end_ticks
    FROM frames k JOIN (SELECT source_key, count(*) AS n FROM frames GROUP BY 1) n USING (source_key) WHERE keyframe AND NOT corrupt WINDOW w AS (PARTITION BY k.source_key ORDER BY frame_id))"""


@query("w4_segments", "SELECT * FROM gops", f"{FRAMES}, {GOPS}")
def w4(spark, d):
    return tl.segments(br.frames(spark, d))


@query("k14_structural_anchors", """SELECT source_key, count(*) AS anchors, min(first) AS first_anchor, max("end") AS covered_to FROM gops GROUP BY 1""", f"{FRAMES}, {GOPS}")
def k14(spark, d):
    return tl.segments(br.frames(spark, d)).groupBy("source_key").agg(F.count("*").alias("anchors"), F.min("first").alias("first_anchor"), F.max("end").alias("covered_to"))


@query("s13_anchor_by_ordinal", """SELECT source_key, ordinal, first, "end" FROM gops WHERE ordinal = 1""", f"{FRAMES}, {GOPS}")
def s13(spark, d):
    return tl.segments(br.frames(spark, d)).filter("ordinal = 1").select("source_key", "ordinal", "first", "end")


SAFETY = """sk AS (SELECT source_key, ticks, row_number() OVER w AS nth, lag(ticks) OVER w AS before FROM frames WHERE keyframe AND NOT corrupt WINDOW w AS (PARTITION BY source_key ORDER BY frame_id)),
safety AS (SELECT source_key, coalesce(ok, true) AS seek_safe FROM (SELECT DISTINCT source_key FROM frames) LEFT JOIN
    (SELECT source_key, bool_and(ticks IS NOT NULL AND (nth = 1 OR coalesce(ticks > before, false))) AS ok FROM sk GROUP BY 1) USING (source_key))"""


@query("w1_seek_safety", "SELECT * FROM safety", f"{FRAMES}, {SAFETY}")
def w1(spark, d):
    return tl.seek_safety(br.frames(spark, d))


@query("j13_resume", """SELECT a.source_key, n.n, CASE WHEN s.seek_safe AND a.anchor_frame IS NOT NULL AND n.n - a.anchor_frame BETWEEN 1 AND 4096 THEN a.anchor_frame ELSE 0 END AS resume_frame,
    s.seek_safe AND a.anchor_frame IS NOT NULL AND n.n - a.anchor_frame BETWEEN 1 AND 4096 AS by_keyframe
    FROM (SELECT source_key, count(*) AS n FROM frames GROUP BY 1) n JOIN anch a ON a.source_key = n.source_key AND a.frame_id = greatest(n.n - 32, 0) JOIN safety s ON s.source_key = n.source_key""", f"{FA}, {SAFETY}")
def j13(spark, d):
    f = br.frames(spark, d)
    return tl.resume_points(tl.anchors(f), tl.seek_safety(f))


@query("w2_cadence", """SELECT source_key, CASE WHEN bool_or(coalesce(step <= 0 OR step <> one, false)) THEN 'variable' WHEN count(step) >= 2 THEN 'constant' ELSE 'unknown' END AS cadence, count(step) AS steps
    FROM (SELECT *, first_value(step IGNORE NULLS) OVER (PARTITION BY source_key ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS one FROM
      (SELECT source_key, frame_id, ticks - lag(ticks) OVER (PARTITION BY source_key ORDER BY frame_id) AS step FROM frames WHERE ticks IS NOT NULL)) GROUP BY 1""")
def w2(spark, d):
    return tl.cadence(br.frames(spark, d))


@query("a1_contiguity", "SELECT source_key, count(*) AS n, min(frame_id) = 0 AND max(frame_id) = count(*) - 1 AND count(DISTINCT frame_id) = count(*) AS dense FROM frames WHERE NOT (source_key % 3 = 0 AND frame_id = 2) GROUP BY 1")
def a1(spark, d):
    return tl.contiguity(br.frames(spark, d).filter("not (source_key % 3 = 0 and frame_id = 2)"))


FAULTS = """SELECT source_key, frame_id, CASE WHEN frame_id < 0 THEN 'id' WHEN duration_ticks <= 0 THEN 'duration' WHEN anchor_frame > frame_id THEN 'anchor after frame'
    WHEN anchor_frame IS NULL AND anchor_ticks IS NOT NULL THEN 'anchor time alone' WHEN keyframe AND NOT corrupt AND anchor_frame IS DISTINCT FROM frame_id THEN 'keyframe not its own anchor'
    WHEN keyframe IS NULL OR corrupt IS NULL THEN 'flags' END AS fault"""
BROKEN = """broken AS (SELECT source_key, frame_id, CASE WHEN frame_id % 19 = 1 THEN 0 ELSE duration_ticks END AS duration_ticks, keyframe, corrupt,
    CASE WHEN frame_id % 23 = 2 THEN frame_id + 1 WHEN frame_id % 29 = 4 THEN NULL ELSE anchor_frame END AS anchor_frame, anchor_ticks FROM anch)"""


def broken(spark, d):
    a = tl.anchors(br.frames(spark, d))
    m = lambda n, r: F.col("frame_id") % n == r
    return a.withColumns({
        "duration_ticks": F.when(m(19, 1), F.lit(0).cast("long")).otherwise(F.col("duration_ticks")),
        "anchor_frame": F.when(m(23, 2), F.col("frame_id") + 1).when(m(29, 4), F.lit(None)).otherwise(F.col("anchor_frame")),
    })


@query("p1_row_validation", f"SELECT * FROM ({FAULTS} FROM broken) WHERE fault IS NOT NULL", f"{FA}, {BROKEN}")
def p1(spark, d):
    return tl.row_faults(broken(spark, d))


@query("a13_status", "SELECT source_key, count(*) AS indexed_frames, max(frame_id) AS last_frame, arg_max(ticks, frame_id) FILTER (ticks IS NOT NULL) AS last_ticks FROM frames GROUP BY 1")
def a13(spark, d):
    return tl.status(br.frames(spark, d))


@query("w12_ordinals", "SELECT source_key, frame_id, row_number() OVER (PARTITION BY source_key ORDER BY frame_id) AS ordinal, count(*) OVER (PARTITION BY source_key) AS total FROM frames WHERE frame_id % 3 = 0")
def w12(spark, d):
    f = br.frames(spark, d)
    return sel.execute(f, sel.plan(f, sel.Request("all", every_n=3))).select("source_key", "frame_id", "ordinal", "total")


@query("w13_seek_distance", "SELECT source_key, frame_id, frame_id - coalesce(anchor_frame, 0) AS distance FROM anch", FA)
def w13(spark, d):
    return tl.anchors(br.frames(spark, d)).select("source_key", "frame_id", (F.col("frame_id") - F.coalesce("anchor_frame", F.lit(0))).alias("distance"))


@query("w14_steps", """SELECT source_key, frame_id, lag(frame_id) OVER w AS previous, lead(frame_id) OVER w AS "next", lag(frame_id) OVER w IS NOT NULL AS has_previous, lead(frame_id) OVER w IS NOT NULL AS has_next FROM frames WINDOW w AS (PARTITION BY source_key ORDER BY frame_id)""")
def w14(spark, d):
    return tl.steps(br.frames(spark, d))


@query("t2_range_visit", "SELECT source_key, frame_id, ticks FROM frames WHERE frame_id >= 4 AND frame_id < 9")
def t2(spark, d):
    return tl.visit(br.frames(spark, d), 4, 9).select("source_key", "frame_id", "ticks")


@query("st12_seek_navigation", "SELECT source_key, frame_id, CASE WHEN seek_safe AND anchor_frame IS NOT NULL THEN anchor_frame ELSE 0 END AS decode_from, frame_id - CASE WHEN seek_safe AND anchor_frame IS NOT NULL THEN anchor_frame ELSE 0 END + 1 AS decoded FROM anch JOIN safety USING (source_key)", f"{FA}, {SAFETY}")
def st12(spark, d):
    f = br.frames(spark, d)
    a = tl.anchors(f).join(tl.seek_safety(f), "source_key")
    start = F.when(F.col("seek_safe") & F.col("anchor_frame").isNotNull(), F.col("anchor_frame")).otherwise(0)
    return a.select("source_key", "frame_id", start.alias("decode_from"), (F.col("frame_id") - start + 1).alias("decoded"))


# Selection

PLAN = "SELECT source_key, a AS first, a + ((b - a) // {e}) * {e} AS last, {e}::BIGINT AS stride, (b - a) // {e} + 1 AS selected FROM ({ends}) WHERE a IS NOT NULL AND b IS NOT NULL AND a >= 0 AND a <= b AND b < n"
ALL = "SELECT source_key, count(*) AS n, 0::BIGINT AS a, count(*) - 1 AS b FROM frames GROUP BY 1"
TIME = """SELECT source_key, count(*) AS n, arg_min(frame_id, (ticks, frame_id)) FILTER (ticks >= 473390) AS a, arg_max(frame_id, (ticks, frame_id)) FILTER (ticks <= 473700) AS b FROM frames GROUP BY 1"""


@query("x1_plan_time", PLAN.format(e=3, ends=TIME))
def x1(spark, d):
    return sel.plan(br.frames(spark, d), sel.Request("time", 473390, 473700, 3))


@query("x1_plan_frames", PLAN.format(e=4, ends="SELECT source_key, count(*) AS n, 2::BIGINT AS a, 31::BIGINT AS b FROM frames GROUP BY 1"))
def x1f(spark, d):
    return sel.plan(br.frames(spark, d), sel.Request("frames", 2, 31, 4))


@query("p5_bounds_gate", PLAN.format(e=1, ends="SELECT source_key, count(*) AS n, 65::BIGINT AS a, 65::BIGINT AS b FROM frames GROUP BY 1"))
def p5(spark, d):
    return sel.plan(br.frames(spark, d), sel.Request("current", 65))


@query("x2_every_nth", f"SELECT source_key, unnest(range(first, last + 1, stride)) AS frame_id FROM ({PLAN.format(e=5, ends=ALL)})")
def x2(spark, d):
    return sel.enumerate_plan(sel.plan(br.frames(spark, d), sel.Request("all", every_n=5)))


@query("x4_execute", f"SELECT f.source_key, f.frame_id, f.ticks, row_number() OVER (PARTITION BY f.source_key ORDER BY f.frame_id) AS ordinal, p.selected AS total FROM frames f JOIN ({PLAN.format(e=3, ends=TIME)}) p ON p.source_key = f.source_key AND f.frame_id BETWEEN p.first AND p.last AND (f.frame_id - p.first) % 3 = 0")
def x4(spark, d):
    f = br.frames(spark, d)
    return sel.execute(f, sel.plan(f, sel.Request("time", 473390, 473700, 3))).select("source_key", "frame_id", "ticks", "ordinal", "total")


@query("k8_file_names", "SELECT source_key, frame_id, 'frame_' || lpad(frame_id::VARCHAR, 20, '0') || '.webp' AS file FROM frames")
def k8(spark, d):
    return br.frames(spark, d).select("source_key", "frame_id", sel.file_name(F.col("frame_id"), "webp").alias("file"))


def _manifest(spark, d):
    f = br.frames(spark, d)
    r = sel.Request("all", every_n=4)
    return sel.manifest(sel.execute(f, sel.plan(f, r)), r, F.when(F.col("source_key") % 10 == 7, F.when(F.col("frame_id") % 8 == 0, 9)).otherwise(9))


MANIFEST = """m AS (SELECT source_key, frame_id, ticks, row_number() OVER (PARTITION BY source_key ORDER BY frame_id) AS ordinal, count(*) OVER (PARTITION BY source_key) AS total,
    CASE WHEN source_key % 10 = 7 THEN CASE WHEN frame_id % 8 = 0 THEN 9 END ELSE 9 END AS bytes FROM frames WHERE frame_id % 4 = 0)"""


@query("k9_manifest_frames", "SELECT source_key, ordinal, total, frame_id, ticks, 'frame_' || lpad(frame_id::VARCHAR, 20, '0') || '.png' AS file, bytes::BIGINT AS bytes FROM m WHERE bytes > 0", f"{FRAMES}, {MANIFEST}")
def k9(spark, d):
    line = _manifest(spark, d).filter("section = 1")
    got = F.from_json("line", "type string, ordinal long, total long, frame_id long, ticks long, duration_ticks long, file string, bytes long")
    return line.select("source_key", got.alias("j")).select("source_key", "j.ordinal", "j.total", "j.frame_id", "j.ticks", "j.file", "j.bytes")


@query("k10_export_outcome", "SELECT source_key, CASE WHEN count(*) = count(bytes) THEN 'complete' ELSE 'failed' END AS status, count(*) AS expected, count(bytes) AS emitted FROM m GROUP BY 1", f"{FRAMES}, {MANIFEST}")
def k10(spark, d):
    line = _manifest(spark, d).filter("section = 2")
    return line.select("source_key", F.from_json("line", "type string, status string, expected long, emitted long").alias("j")).select("source_key", "j.status", "j.expected", "j.emitted")


@query("x6_manifest_header", "SELECT source_key, 'all' AS kind, 4::BIGINT AS every_n, 'png' AS format, count(*) AS total FROM m GROUP BY 1", f"{FRAMES}, {MANIFEST}")
def x6(spark, d):
    line = _manifest(spark, d).filter("section = 0")
    got = F.from_json("line", "type string, version int, selection struct<kind:string,start:long,end:long>, every_n long, format string, total long")
    return line.select("source_key", got.alias("j")).select("source_key", "j.selection.kind", "j.every_n", "j.format", "j.total")


@query("x5_seconds_to_us", """SELECT o_orderkey AS id, t, CASE WHEN regexp_matches(t, '^[0-9]{1,12}(\\.[0-9]{1,18})?$') AND t::DECIMAL(38,18) * 1000000 = floor(t::DECIMAL(38,18) * 1000000)
    THEN (t::DECIMAL(38,18) * 1000000)::BIGINT END AS us FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.5' WHEN 1 THEN o_orderkey || '.0000001' WHEN 2 THEN o_orderkey::VARCHAR ELSE '-1' END AS t FROM orders)""", "")
def x5(spark, d):
    t = F.when(F.col("o_orderkey") % 4 == 0, F.concat("o_orderkey", F.lit(".5"))).when(F.col("o_orderkey") % 4 == 1, F.concat("o_orderkey", F.lit(".0000001"))).when(F.col("o_orderkey") % 4 == 2, F.col("o_orderkey").cast("string")).otherwise("-1")
    o = br.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t"))
    return o.select("id", "t", tb.seconds_to_us(F.col("t")).alias("us"))


# Groups

RUNS = """ru AS (SELECT *, value IS DISTINCT FROM lag(value) OVER w OR lag(frame_id) OVER w IS NULL AS ch FROM frames WINDOW w AS (PARTITION BY source_key ORDER BY frame_id)),
rn AS (SELECT *, (sum(ch::INT) OVER (PARTITION BY source_key ORDER BY frame_id) - 1)::BIGINT AS ordinal FROM ru),
runs AS (SELECT source_key, ordinal, min(frame_id) AS first, max(frame_id) AS last, count(*) AS frames, min(frame_id) AS representative FROM rn GROUP BY 1, 2)"""


def runs(spark, d):
    return gr.exact_runs(br.frames(spark, d), "value")


@query("st1_exact_groups", "SELECT * FROM runs", f"{FRAMES}, {RUNS}")
def st1(spark, d):
    return runs(spark, d)


SCORE = "(10000 - (abs({a} - {b}) * 10000 + 127) // 255)"
FOLD = f"""g AS (SELECT source_key, frame_id, luma AS rep, luma AS prev, 0::BIGINT AS ordinal, frame_id AS first, 10000::BIGINT AS low FROM frames WHERE frame_id = 0
    UNION ALL SELECT f.source_key, f.frame_id, CASE WHEN ok THEN rep ELSE luma END, luma, CASE WHEN ok THEN ordinal ELSE ordinal + 1 END, CASE WHEN ok THEN first ELSE f.frame_id END, CASE WHEN ok THEN least(low, s) ELSE 10000 END
    FROM (SELECT f.*, g.rep, g.ordinal, g.first, g.low, {SCORE.format(a='g.rep', b='f.luma')} AS s, {SCORE.format(a='g.rep', b='f.luma')} >= 9700 AND {SCORE.format(a='g.prev', b='f.luma')} >= 9700 AS ok
      FROM g JOIN frames f ON f.source_key = g.source_key AND f.frame_id = g.frame_id + 1) f),
groups AS (SELECT source_key, ordinal, first, max(frame_id) AS last, count(*) AS frames, min(low)::INTEGER AS floor FROM g GROUP BY 1, 2, 3)"""


def groups(spark, d):
    return gr.greedy_groups(br.frames(spark, d), "luma", 9700)


@query("st2_luma_groups", "SELECT * FROM groups", f"{FRAMES}, {FOLD}", True)
def st2(spark, d):
    return groups(spark, d)


BENT = """bent AS (SELECT source_key, ordinal, first + CASE WHEN ordinal = 2 AND source_key % 3 = 0 THEN 1 WHEN ordinal = 0 AND source_key % 7 = 1 THEN 1 ELSE 0 END AS first, last, frames FROM runs)"""


@query("w5_group_tiling", """SELECT source_key, arg_min(fault, ordinal) AS fault, count(*) AS faults FROM (SELECT source_key, ordinal, CASE WHEN last < first THEN 'bounds' WHEN frames <> last - first + 1 THEN 'count'
    WHEN before IS NULL AND first <> 0 THEN 'late start' WHEN before IS NOT NULL AND first > before + 1 THEN 'gap' WHEN first <= before THEN 'overlap' WHEN after IS NULL AND last <> n - 1 THEN 'early end' END AS fault
    FROM (SELECT b.*, c.n, lag(last) OVER w AS before, lead(first) OVER w AS after FROM bent b JOIN (SELECT source_key, count(*) AS n FROM frames GROUP BY 1) c USING (source_key) WINDOW w AS (PARTITION BY source_key ORDER BY ordinal)))
    WHERE fault IS NOT NULL GROUP BY 1""", f"{FRAMES}, {RUNS}, {BENT}")
def w5(spark, d):
    f = br.frames(spark, d)
    r = gr.exact_runs(f, "value")
    bend = F.when((F.col("ordinal") == 2) & (F.col("source_key") % 3 == 0), 1).when((F.col("ordinal") == 0) & (F.col("source_key") % 7 == 1), 1).otherwise(0)
    return gr.group_faults(r.withColumn("first", F.col("first") + bend), f.groupBy("source_key").agg(F.count("*").alias("n")))


@query("p4_group_validity", "SELECT source_key, ordinal, last >= first AND frames = last - first + 1 AND first >= 0 AS valid FROM bent", f"{FRAMES}, {RUNS}, {BENT}")
def p4(spark, d):
    bend = F.when((F.col("ordinal") == 2) & (F.col("source_key") % 3 == 0), 1).when((F.col("ordinal") == 0) & (F.col("source_key") % 7 == 1), 1).otherwise(0)
    r = runs(spark, d).withColumn("first", F.col("first") + bend)
    return r.select("source_key", "ordinal", ((F.col("last") >= F.col("first")) & (F.col("frames") == F.col("last") - F.col("first") + 1) & (F.col("first") >= 0)).alias("valid"))


@query("j8_group_of_frame", "SELECT f.source_key, f.frame_id, r.ordinal FROM frames f JOIN runs r ON r.source_key = f.source_key AND f.frame_id BETWEEN r.first AND r.last", f"{FRAMES}, {RUNS}")
def j8(spark, d):
    return gr.containing(runs(spark, d), br.frames(spark, d).select("source_key", "frame_id"))


@query("j9_representatives", "SELECT f.source_key, f.frame_id, f.ticks FROM frames f WHERE EXISTS (SELECT 1 FROM groups g WHERE g.source_key = f.source_key AND g.first = f.frame_id)", f"{FRAMES}, {FOLD}", True)
def j9(spark, d):
    return gr.representatives(br.frames(spark, d), groups(spark, d)).select("source_key", "frame_id", "ticks")


@query("j10_neighbour_groups", "SELECT source_key, ordinal, lag(first) OVER w AS previous_first, lead(first) OVER w AS next_first FROM runs WINDOW w AS (PARTITION BY source_key ORDER BY ordinal)", f"{FRAMES}, {RUNS}")
def j10(spark, d):
    return gr.neighbours(runs(spark, d))


@query("k11_unique_export", "SELECT source_key, first AS frame_id, row_number() OVER (PARTITION BY source_key ORDER BY ordinal) AS line, frames AS group_frames, floor FROM groups", f"{FRAMES}, {FOLD}", True)
def k11(spark, d):
    w = Window.partitionBy("source_key").orderBy("ordinal")
    return groups(spark, d).select("source_key", F.col("first").alias("frame_id"), F.row_number().over(w).cast("long").alias("line"), F.col("frames").alias("group_frames"), "floor")


@query("x3_representative_cursor", "SELECT source_key, ordinal, representative, first, last FROM runs", f"{FRAMES}, {RUNS}")
def x3(spark, d):
    return runs(spark, d).orderBy("source_key", "ordinal").select("source_key", "ordinal", "representative", "first", "last")


# Time

@query("f1_ticks_to_us", """SELECT o_orderkey AS id, CASE WHEN us BETWEEN -9223372036854775808 AND 9223372036854775807 THEN us::BIGINT END AS us FROM
    (SELECT o_orderkey, ((o_orderkey - 3000)::HUGEINT * CASE WHEN o_orderkey % 2 = 0 THEN 90001 ELSE 7000000000 END * 1001 * 1000000) // 30000 AS us FROM orders)""", "")
def f1(spark, d):
    o = br.read(spark, d, "orders")
    t = (F.col("o_orderkey") - 3000) * F.when(F.col("o_orderkey") % 2 == 0, F.lit(90001)).otherwise(F.lit(7000000000))
    return o.select(F.col("o_orderkey").alias("id"), tb.ticks_to_us(t, F.lit(1001), F.lit(30000)).alias("us"))


@query("f2_rational", "SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE / nullif(l_orderkey, 0) AS value FROM lineitem", "")
def f2(spark, d):
    return br.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tb.rational(F.col("l_linenumber"), F.col("l_orderkey")).alias("value"))


@query("f4_fractions", "SELECT source_key, frame_id, CASE WHEN n <= 1 THEN 0.0 ELSE frame_id / (n - 1)::DOUBLE END AS fraction, floor(least(1.0, luma / 150.0::DOUBLE) * greatest(n - 1, 0) + 0.5)::BIGINT AS target FROM frames JOIN (SELECT source_key, count(*) AS n FROM frames GROUP BY 1) USING (source_key)")
def f4(spark, d):
    f = br.frames(spark, d)
    f = f.join(f.groupBy("source_key").agg(F.count("*").alias("n")), "source_key")
    return f.select("source_key", "frame_id", tb.fraction_of_frame(F.col("frame_id"), F.col("n")).alias("fraction"), tb.frame_of_fraction(F.col("luma") / 150.0, F.col("n")).alias("target"))


@query("f5_step_target", "SELECT o_orderkey AS id, greatest(0, least(99, CASE WHEN o_orderkey % 3 = 0 THEN 9223372036854775807 WHEN o_orderkey % 3 = 1 THEN 50 + o_orderkey % 100 - 70 ELSE 0 END))::BIGINT AS target FROM orders", "")
def f5(spark, d):
    k = F.col("o_orderkey")
    step = F.when(k % 3 == 0, F.lit(tb.I64_MAX)).when(k % 3 == 1, k % 100 - 70).otherwise(F.lit(-tb.I64_MAX))
    return br.read(spark, d, "orders").select(k.alias("id"), tb.step_target(F.lit(50).cast("long"), step, F.lit(99).cast("long")).alias("target"))


@query("f6_format_time", "SELECT event_id, printf('%d:%02d:%02d.%06d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us % 1000000) AS text FROM (SELECT event_id, epoch_us(ts) % 86400000000 AS us FROM events)", "")
def f6(spark, d):
    return br.events(spark, d).select("event_id", tb.format_timestamp(F.col("us") % 86_400_000_000).alias("text"))


@query("f8_budget_share", "SELECT c_custkey, 1000003 // n + CASE WHEN nth - 1 < 1000003 % n THEN 1 ELSE 0 END AS share FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)", "")
def f8(spark, d):
    w = Window.partitionBy("c_nationkey")
    c = br.read(spark, d, "customer").select("c_custkey", F.row_number().over(w.orderBy("c_custkey")).alias("nth"), F.count("*").over(w).alias("n"))
    return c.select("c_custkey", tb.share(F.lit(1000003), F.col("n"), F.col("nth")).alias("share"))


@query("f9_saturating", "SELECT o_orderkey AS id, least(9223372036854775807, 9223372036854770000::HUGEINT + o_orderkey)::BIGINT AS total FROM orders", "")
def f9(spark, d):
    return br.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tb.saturating_add(F.lit(9223372036854770000), F.col("o_orderkey")).alias("total"))


@query("f10_rotation", "SELECT o_orderkey AS id, ((90 * (o_orderkey % 13 - 6)) % 360 + 360) % 360 AS degrees FROM orders", "")
def f10(spark, d):
    return br.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tb.rotation(90 * (F.col("o_orderkey") % 13 - 6)).alias("degrees"))


@query("f11_power", "SELECT event_id, k * 3.6::DOUBLE / nullif(event_id % 50, 0) / 1000.0::DOUBLE AS watts FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)", "")
def f11(spark, d):
    return br.events(spark, d).select("event_id", tb.watts(F.col("k"), F.col("event_id") % 50).alias("watts"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """As-of lookups of ten times in every source."""
    return j2(spark, sf_dir)
