"""Similarity, library, telemetry and cache queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions import policy
from ..operators import cache as ca
from ..operators import library as li
from ..operators import similarity as si
from ..operators import telemetry as te
from . import bridge as br
from .bridge import FRAMES, GRID, LIBRARY, LOG, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


# Hashes and similarity over the luma grids

BITS = "list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN {test} THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0 END))"
SIGNED = "(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT"
HASHED = f"""{GRID}, ah0 AS (SELECT frame_id, v, {BITS.format(n=64, test='v[i] >= m')} AS h FROM (SELECT *, (list_sum(v)::BIGINT + 32) // 64 AS m FROM grid)),
ah AS (SELECT frame_id, v, {SIGNED} AS average_hash FROM ah0),
dh0 AS (SELECT frame_id, list_sum(list_transform(range(0, 56), lambda p: CASE WHEN v[(p // 7) * 8 + p % 7 + 1] > v[(p // 7) * 8 + p % 7 + 2] THEN (1::HUGEINT << p::INTEGER) ELSE 0 END)) AS h FROM grid),
hashed AS (SELECT ah.frame_id, ah.v, ah.average_hash, {SIGNED} AS difference_hash FROM ah JOIN dh0 USING (frame_id))"""


def hashed(spark, d):
    g = br.grid(spark, d)
    return g.withColumns({"average_hash": px.grid_average_hash(F.col("v")), "difference_hash": px.grid_difference_hash(F.col("v"))})


@query("g6_average_hash", "SELECT frame_id, average_hash FROM hashed", HASHED)
def g6(spark, d):
    return hashed(spark, d).select("frame_id", "average_hash")


@query("g4_difference_hash", "SELECT frame_id, difference_hash FROM hashed", HASHED)
def g4(spark, d):
    return hashed(spark, d).select("frame_id", "difference_hash")


@query("g1_luma", "SELECT p_partkey AS id, (77 * r + 150 * g + 29 * b + 128) >> 8 AS luma FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part)")
def g1(spark, d):
    k = F.col("p_partkey")
    return br.read(spark, d, "part").select(k.alias("id"), px.luma_column(k % 256, k * 7 % 256, k * 13 % 256).alias("luma"))


BANDS = f"""{HASHED}, bands AS (SELECT frame_id, 0 AS kind, b AS band, ((average_hash >> (16 * b)::INTEGER) & 65535)::INTEGER AS value FROM hashed, range(4) t(b)
    UNION ALL SELECT frame_id, 1, b, ((difference_hash >> (16 * b)::INTEGER) & 65535)::INTEGER FROM hashed, range(4) t(b)
    UNION ALL SELECT frame_id, 2, 0, (c + c * 32 + c * 1024)::INTEGER FROM (SELECT frame_id, ((list_sum(v)::BIGINT + 32) // 64) // 8 AS c FROM hashed))"""


def keyed(spark, d):
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x) + 32
    c = F.shiftright(F.shiftright(total, 6), 3)
    return hashed(spark, d).withColumn("bucket", (c * 1057).cast("int"))


@query("g17_bands", "SELECT frame_id, kind, band, value FROM bands", BANDS)
def g17(spark, d):
    return si.keys(keyed(spark, d))


@query("g16_colour_bucket", "SELECT frame_id, value AS bucket FROM bands WHERE kind = 2", BANDS)
def g16(spark, d):
    return keyed(spark, d).select("frame_id", "bucket")


@query("a2_band_completeness", "SELECT frame_id, count(*) AS n FROM bands WHERE NOT (frame_id % 10 = 3 AND kind = 1 AND band = 2) GROUP BY 1 HAVING count(*) <> 9", BANDS)
def a2(spark, d):
    return si.incomplete(si.keys(keyed(spark, d)).filter("not (frame_id % 10 = 3 and kind = 1 and band = 2)"))


CANDIDATES = f"""{BANDS}, cand AS (SELECT DISTINCT a.frame_id AS target, b.frame_id FROM bands a JOIN bands b ON a.kind = b.kind AND a.band = b.band AND a.frame_id <> b.frame_id
    AND (a.kind < 2 AND a.value = b.value OR a.kind = 2 AND abs((a.value & 31) - (b.value & 31)) <= 2) WHERE a.frame_id % 25 = 0)"""


def cand(spark, d):
    k = keyed(spark, d)
    return si.candidates(k, k.filter("frame_id % 25 = 0"))


@query("j7_candidates", "SELECT * FROM cand", CANDIDATES)
def j7(spark, d):
    return cand(spark, d)


@query("u2_candidate_union", "SELECT target, count(*) AS candidates, min(frame_id) AS first FROM cand GROUP BY 1", CANDIDATES)
def u2(spark, d):
    return cand(spark, d).groupBy("target").agg(F.count("*").alias("candidates"), F.min("frame_id").alias("first"))


LIKE = """(10000 - (list_sum(list_transform(range(1, 65), lambda i: abs(x.v[i] - y.v[i])))::BIGINT * 10000 + 64 * 255 // 2) // (64 * 255))"""
SCORED = f"{CANDIDATES}, scored AS (SELECT c.target, c.frame_id, {LIKE} AS similarity FROM cand c JOIN grid x ON x.frame_id = c.target JOIN grid y ON y.frame_id = c.frame_id)"


def luma_frames(spark, d):
    """Described grids, and the targets among them."""
    k = si.describe_luma(br.spread(br.grid(spark, d)))
    return k, k.filter("frame_id % 25 = 0")


def scored_by_band(k, targets):
    """The scores of the candidates that aren't near in colour."""
    return si.luma_pairs(si.by_band(k, targets), k)


def scored(spark, d):
    k, targets = luma_frames(spark, d)
    return si.luma_near(k, targets).union(scored_by_band(k, targets))


def top_scored(spark, d):
    k, targets = luma_frames(spark, d)
    return si.top_of_parts(si.best_near(k, targets, "luma", si.scan_luma, 9350, 8), scored_by_band(k, targets), 9350, 8)


@query("g10_luma_similarity", "SELECT * FROM scored", SCORED)
def g10(spark, d):
    return scored(spark, d)


TOP = """SELECT target, rank, frame_id, similarity, candidates, matched, matched > 8 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY target) AS matched,
    row_number() OVER (PARTITION BY target ORDER BY similarity DESC, frame_id) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY target) AS candidates FROM scored) WHERE similarity >= 9350) WHERE rank <= 8"""


@query("t1_top_similar", TOP, SCORED)
def t1(spark, d):
    return top_scored(spark, d)


@query("a6_candidate_counts", f"SELECT DISTINCT target, candidates, matched FROM ({TOP})", SCORED)
def a6(spark, d):
    return top_scored(spark, d).select("target", "candidates", "matched").distinct()


@query("g8_hamming", "SELECT c.target, c.frame_id, bit_count(xor(a.average_hash, b.average_hash))::BIGINT AS distance, 10000 - (bit_count(xor(a.average_hash, b.average_hash)) * 10000 + 32) // 64 AS score FROM cand c JOIN hashed a ON a.frame_id = c.target JOIN hashed b ON b.frame_id = c.frame_id", CANDIDATES)
def g8(spark, d):
    h = hashed(spark, d).select("frame_id", "average_hash")
    p = cand(spark, d).join(h, "frame_id").join(h.toDF("target", "other"), "target")
    x = px.distance(F.col("average_hash"), F.col("other"))
    return p.select("target", "frame_id", x.alias("distance"), px.hash_score(x).alias("score"))


@query("a5_distance_histogram", "SELECT b AS bucket, count(d) AS n FROM range(65) t(b) LEFT JOIN (SELECT bit_count(xor(a.average_hash, h.average_hash)) AS d FROM cand c JOIN hashed a ON a.frame_id = c.target JOIN hashed h ON h.frame_id = c.frame_id) ON d = b GROUP BY 1", CANDIDATES)
def a5(spark, d):
    return te.histogram(g8(spark, d), "distance", 1, 65)


@query("a5_score_histogram", "SELECT b AS bucket, count(s) AS n FROM range(101) t(b) LEFT JOIN (SELECT least(similarity // 100, 100) AS s FROM scored) ON s = b GROUP BY 1", SCORED)
def a5s(spark, d):
    k, targets = luma_frames(spark, d)
    far = scored_by_band(k, targets).select("similarity", F.lit(1).cast("long").alias("n"))
    return te.histogram(si.luma_counts(k, targets).union(far), "similarity", 100, 101, "n")


@query("j15_similar_frames")
def j15(spark, d):
    """Resampled descriptors, banded candidates, confirmation over moves and crops, top k."""
    x = br.descriptors(spark, d)
    return si.similar_frames(x, x.filter("frame_id % 50 = 0"), 9300, 64)


@query("k6_descriptors")
def k6(spark, d):
    x = br.descriptors(spark, d)
    return x.select("frame_id", "average_hash", "difference_hash", "bucket", F.sha2("rgb", 256).alias("rgb_sha256"))


@query("g19_pixel_sample", "SELECT p_partkey AS id, CASE WHEN x < 4 AND y < 2 THEN upper(substr(hex, (y * 20 + x * 4) * 2 + 1, 8)) END AS rgba FROM (SELECT p_partkey, p_partkey % 5 AS x, p_partkey % 3 AS y, '000102030405060708090a0b0c0d0e0f0000000010111213141516171819 1a1b1c1d1e1f00000000' AS h0, replace('000102030405060708090a0b0c0d0e0f0000000010111213141516171819 1a1b1c1d1e1f00000000', ' ', '') AS hex FROM part)")
def g19(spark, d):
    row = bytes(range(16)) + bytes(4) + bytes(range(16, 32)) + bytes(4)
    k = F.col("p_partkey")
    at = px.sample_at(F.unhex(F.lit(row.hex())), F.lit(4), F.lit(2), F.lit(20), (k % 5).cast("int"), (k % 3).cast("int"))
    return br.read(spark, d, "part").select(k.alias("id"), at.alias("rgba"))


# Quality and telemetry

@query("a3_confusion", "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels")
def a3(spark, d):
    return te.confusion(br.read(spark, d, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("predicted")))


@query("a4_quality", "SELECT *, (tp * 10000 + (tp + fp) // 2) // nullif(tp + fp, 0) AS precision_bps, (tp * 10000 + (tp + fn) // 2) // nullif(tp + fn, 0) AS recall_bps, (2 * tp * 10000 + (2 * tp + fp + fn) // 2) // nullif(2 * tp + fp + fn, 0) AS f1_bps FROM c",
       "c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)")
def a4(spark, d):
    return te.quality(a3(spark, d))


@query("a9_latency", "SELECT event_type, count(k) AS samples, sum(k)::BIGINT AS total, max(k) AS most, arg_max(k, event_id) AS last, (sum(k) // nullif(count(k), 0))::BIGINT AS mean FROM f0 GROUP BY 1", "f0 AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def a9(spark, d):
    return te.latencies(br.events(spark, d), "event_type", "k", "event_id")


@query("a12_median", "SELECT event_type, median, max(abs(x - median) / nullif(median, 0.0)) AS deviation FROM v JOIN (SELECT event_type, median(x) AS median FROM v GROUP BY 1) USING (event_type) GROUP BY 1, 2", "v AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events)")
def a12(spark, d):
    return te.medians(br.events(spark, d).select("event_type", F.col("k").cast("double").alias("x")), "event_type", "x")


@query("w6_coverage", "SELECT source_key, sequence, epoch, max(current_us) OVER w AS max_us, min(current_us) OVER w AS first_us FROM (SELECT *, (sum(is_rebuild::INT) OVER (PARTITION BY source_key ORDER BY sequence))::BIGINT AS epoch FROM samples) WINDOW w AS (PARTITION BY source_key, epoch ORDER BY sequence)", SAMPLES)
def w6(spark, d):
    return te.coverage(br.samples(spark, d))


ADV = """adv AS (SELECT source_key, sequence, stage, greatest(indexed_frames - lag(indexed_frames) OVER w, CASE WHEN lag(indexed_frames) OVER w IS NOT NULL THEN 0 END) AS frames_advance,
    greatest(elapsed_ms - lag(elapsed_ms) OVER w, CASE WHEN lag(elapsed_ms) OVER w IS NOT NULL THEN 0 END) AS ms_advance FROM samples WINDOW w AS (PARTITION BY source_key, stage ORDER BY sequence))"""


@query("w7_advance", "SELECT *, frames_advance * 1000000 // nullif(ms_advance, 0) AS milli_rate FROM adv", f"{SAMPLES}, {ADV}")
def w7(spark, d):
    x = te.advances(br.samples(spark, d))
    w = Window.partitionBy("source_key", "stage").orderBy("sequence")
    has = F.lag("sequence").over(w).isNotNull()
    return x.withColumns({c: F.when(has, F.col(c)) for c in ("frames_advance", "ms_advance", "milli_rate")})


THR = """st AS (SELECT * FROM (SELECT *, coalesce(indexed_frames > lag(indexed_frames) OVER (PARTITION BY source_key ORDER BY sequence), true) AS fs FROM samples) WHERE fs),
rt AS (SELECT source_key, sequence, (indexed_frames - lag(indexed_frames) OVER w) * 1000.0::DOUBLE / nullif(elapsed_ms - lag(elapsed_ms) OVER w, 0) AS rate FROM st WINDOW w AS (PARTITION BY source_key ORDER BY sequence))"""


@query("w8_throughput", "SELECT source_key, sequence, rate, median(rate) OVER (PARTITION BY source_key ORDER BY sequence ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS median_rate FROM rt WHERE rate IS NOT NULL", f"{SAMPLES}, {THR}")
def w8(spark, d):
    return te.throughput(br.samples(spark, d))


def _progress(spark, d):
    s = br.samples(spark, d)
    w = Window.partitionBy("source_key")
    span = F.max("current_us").over(w) - F.min("current_us").over(w)
    return s.withColumns({"covered_us": F.col("current_us") - F.min("current_us").over(w), "duration_us": span})


@query("w9_eta")
def w9(spark, d):
    return te.estimates(_progress(spark, d)).select("source_key", "sequence", "eta_min", "eta_max")


@query("w10_stall")
def w10(spark, d):
    return te.estimates(_progress(spark, d)).select("source_key", "sequence", "stalled")


@query("w11_work_cycles", "SELECT source_key, sequence, (elapsed_ms - lag(elapsed_ms) OVER w) * 1000000 AS nanos FROM st WINDOW w AS (PARTITION BY source_key ORDER BY sequence) QUALIFY lag(elapsed_ms) OVER w IS NOT NULL", f"{SAMPLES}, {THR}")
def w11(spark, d):
    return te.work_cycles(br.samples(spark, d))


@query("a10_indexing_report", "SELECT stage, count(*) AS samples, max(indexed_frames) AS frames, (max(elapsed_ms) - min(elapsed_ms))::BIGINT AS ms, (max(indexed_frames) * 1000000 // nullif(max(elapsed_ms) - min(elapsed_ms), 0))::BIGINT AS milli_rate FROM samples GROUP BY 1", SAMPLES)
def a10(spark, d):
    g = br.samples(spark, d).groupBy("stage").agg(F.count("*").alias("samples"), F.max("indexed_frames").alias("frames"), (F.max("elapsed_ms") - F.min("elapsed_ms")).alias("ms"))
    return g.withColumn("milli_rate", F.expr("frames * 1000000 div nullif(ms, 0)"))


@query("a16_transport", "SELECT event_type, sum(CASE WHEN k > 50 THEN k ELSE 0 END)::BIGINT AS bytes, count(*) FILTER (k > 50) AS allocations, count(*) FILTER (k <= 50) AS reuses FROM f0 GROUP BY 1", "f0 AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def a16(spark, d):
    k = F.col("k")
    return br.events(spark, d).groupBy("event_type").agg(F.sum(F.when(k > 50, k).otherwise(0)).alias("bytes"), F.count_if(k > 50).alias("allocations"), F.count_if(k <= 50).alias("reuses"))


@query("a17_stream_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS video, count(*) FILTER (event_type = 'click') AS audio FROM events GROUP BY 1")
def a17(spark, d):
    return br.read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("video"), F.count_if(F.col("event_type") == "click").alias("audio"))


@query("a14_digest")
def a14(spark, d):
    from ..functions.hashing import fnv1a_digest

    return fnv1a_digest(br.frames(spark, d), "source_key", "frame_id", "ticks")


@query("a15_counts", "SELECT l_returnflag AS layer, count(*) AS artifacts FROM lineitem GROUP BY 1")
def a15(spark, d):
    return br.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("layer")).agg(F.count("*").alias("artifacts"))


@query("f7_ram_budget", """SELECT c_custkey, greatest(0, least(CASE WHEN low THEN 32 * 1048576 WHEN total > 0 THEN least(total // 16, 768 * 1048576) ELSE 16 * 1048576 END, h // 3))::BIGINT AS automatic,
    greatest(0, least(CASE WHEN low THEN 64 * 1048576 WHEN total > 0 THEN least(total // 12, 1024 * 1048576) ELSE 32 * 1048576 END, h // 2))::BIGINT AS aggressive,
    (CASE WHEN low THEN 128 * 1048576 WHEN total <= 0 THEN 128 * 1048576 ELSE greatest(least(total // 8, 1024 * 1048576), 16 * 1048576) END)::BIGINT AS custom
    FROM (SELECT *, greatest(avail - greatest(CASE WHEN total > 0 THEN total // 8 ELSE 0 END, 2 * 104857600, 256 * 2097152), 0) AS h FROM
      (SELECT c_custkey, (c_custkey % 40) * 268435456 AS total, (c_custkey % 37 + 1) * 134217728 AS avail, c_custkey % 11 = 0 AS low FROM customer))""")
def f7(spark, d):
    k = F.col("c_custkey").cast("long")
    total, avail = (k % 40) * 268435456, (k % 37 + 1) * 134217728
    a, b, c = policy.budgets(total, avail, F.lit(104857600).cast("long"), F.lit(256).cast("long"), k % 11 == 0)
    return br.read(spark, d, "customer").select("c_custkey", a.alias("automatic"), b.alias("aggressive"), c.alias("custom"))


# Library and catalog

@query("j11_library_reconcile", "SELECT * FROM reconciled", LIBRARY)
def j11(spark, d):
    return li.reconcile(br.library(spark, d), br.catalog(spark, d))


@query("u1_library_union", "SELECT status, count(*) AS n FROM reconciled GROUP BY 1", LIBRARY)
def u1(spark, d):
    return j11(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("u3_index_only", "SELECT c.source_key, c.status FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM library l WHERE l.source_key = c.source_key AND l.stream_index = c.stream_index)", LIBRARY)
def u3(spark, d):
    c, s = br.catalog(spark, d), br.library(spark, d)
    return c.join(s, ["source_key", "stream_index"], "left_anti").select("source_key", "status")


@query("t3_normalise", """SELECT id, uri, opened_ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS n FROM (SELECT 'd' || substr(id, 2)::BIGINT % 211 AS id, uri, opened_ms, substr(id, 2)::BIGINT AS position FROM library) WHERE uri IS NOT NULL) WHERE n = 1 ORDER BY opened_ms DESC, position LIMIT 100""", LIBRARY)
def t3(spark, d):
    p = F.substring("id", 2, 20).cast("long")
    r = br.library(spark, d).select(F.concat(F.lit("d"), p % 211).alias("id"), "uri", "opened_ms", p.alias("position"))
    return li.normalise(r).select("id", "uri", "opened_ms")


@query("t4_library_order", "SELECT id, row_number() OVER (ORDER BY greatest(opened_ms, coalesce(modified_ms, 0)) DESC, id) AS place FROM reconciled", LIBRARY)
def t4(spark, d):
    return li.numbered(j11(spark, d), [F.bitwise_not(li.recency()), F.col("id")]).select("id", "place")


@query("t5_home", "SELECT id, opened_ms FROM library WHERE uri IS NOT NULL ORDER BY opened_ms DESC, id LIMIT 3", LIBRARY)
def t5(spark, d):
    return li.home(br.library(spark, d)).select("id", "opened_ms")


@query("k17_upsert", "SELECT id, uri, opened_ms FROM library WHERE id NOT IN (SELECT id FROM nw) AND (uri IS NULL OR uri NOT IN (SELECT uri FROM nw WHERE uri IS NOT NULL)) UNION ALL SELECT * FROM nw", f"{LIBRARY}, nw AS (SELECT id, 'content://m/' || (substr(id, 2)::BIGINT + 1) AS uri, 5::BIGINT AS opened_ms FROM library WHERE substr(id, 2)::BIGINT % 10 = 4)")
def k17(spark, d):
    old = br.library(spark, d).select("id", "uri", "opened_ms")
    p = F.substring("id", 2, 20).cast("long")
    new = old.filter(p % 10 == 4).select("id", F.concat(F.lit("content://m/"), p + 1).alias("uri"), F.lit(5).cast("long").alias("opened_ms"))
    return li.upsert(old, new)


@query("p11_category", """SELECT id, CASE WHEN k % 7 = 0 THEN 'PermissionLost' WHEN k % 7 = 1 THEN 'Missing' WHEN status = 'Stale' THEN 'Stale' WHEN status = 'InProgress' THEN 'InProgress' WHEN status = 'Available' THEN 'Indexed' ELSE 'Recent' END AS category
    FROM (SELECT *, length(id) + opened_ms AS k FROM reconciled)""", LIBRARY)
def p11(spark, d):
    k = (F.length("id") + F.col("opened_ms")) % 7
    a = F.when(k == 0, "PermissionLost").when(k == 1, "MissingDocument").otherwise("Available")
    return j11(spark, d).select("id", li.category(a, F.col("status")).alias("category"))


LISTING = "listing AS (SELECT l_suppkey::VARCHAR AS source_key, l_linenumber % 2 AS stream_index, 1 + l_partkey % 3 AS version, l_quantity > 25 AS complete, 'v/' || l_orderkey || '-' || l_linenumber AS path FROM lineitem)"


def listing(spark, d):
    return br.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_key"), (F.col("l_linenumber") % 2).alias("stream_index"), (1 + F.col("l_partkey") % 3).alias("version"), (F.col("l_quantity") > 25).alias("complete"), F.concat(F.lit("v/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("path"))


@query("s9_catalog_scan", "SELECT source_key, stream_index, path, CASE WHEN version <> 2 THEN 'Stale' WHEN complete THEN 'Indexed' ELSE 'InProgress' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY source_key, stream_index ORDER BY version = 2 DESC, version DESC, path) AS n FROM listing) WHERE n = 1", LISTING)
def s9(spark, d):
    return li.catalog_entries(listing(spark, d), 2).select("source_key", "stream_index", "path", "status")


@query("a7_storage", "SELECT category, sum(bytes)::BIGINT AS bytes, count(*) AS files, count(DISTINCT source_key) AS sources FROM (SELECT l_linestatus AS category, (l_quantity * 1000)::BIGINT AS bytes, l_suppkey AS source_key FROM lineitem) GROUP BY ROLLUP (category)")
def a7(spark, d):
    f = br.read(spark, d, "lineitem").select(F.col("l_linestatus").alias("category"), (F.col("l_quantity") * 1000).cast("long").alias("bytes"), F.col("l_suppkey").alias("source_key"))
    return li.storage(f)


@query("k13_latest_artifact", "SELECT storage_key, arg_max(v, (d, o, l)) AS value FROM (SELECT l_partkey AS storage_key, l_quantity::DOUBLE AS v, l_shipdate AS d, l_orderkey AS o, l_linenumber AS l FROM lineitem) GROUP BY 1")
def k13(spark, d):
    x = br.read(spark, d, "lineitem")
    return x.groupBy(F.col("l_partkey").alias("storage_key")).agg(F.max_by(F.col("l_quantity").cast("double"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("value"))


@query("p6_safe_paths", """SELECT p_partkey AS id, k AS key, regexp_matches(k, '^[A-Za-z0-9_-]{1,256}$') AS safe_key, length(k) > 0 AND NOT starts_with(k, '/') AND NOT contains(k, chr(92)) AND NOT regexp_matches(k, '(^|/)\\.{0,2}(/|$)') AS safe_path
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a/../b' WHEN 1 THEN 'ok_' || p_partkey WHEN 2 THEN '/x' WHEN 3 THEN 'v/' || p_partkey || '.png' ELSE '' END AS k FROM part)""")
def p6(spark, d):
    p = F.col("p_partkey")
    k = F.when(p % 5 == 0, "a/../b").when(p % 5 == 1, F.concat(F.lit("ok_"), p)).when(p % 5 == 2, "/x").when(p % 5 == 3, F.concat(F.lit("v/"), p, F.lit(".png"))).otherwise("")
    return br.read(spark, d, "part").select(p.alias("id"), k.alias("key"), li.safe_key(k).alias("safe_key"), li.safe_path(k).alias("safe_path"))


@query("p7_metadata_sanity", "SELECT p_partkey AS id, p_size * 1500 BETWEEN 1 AND 65535 AND p_partkey % 5 * 90 IN (0, 90, 180, 270) AND p_retailprice > 0 AND p_retailprice <= 1000 AS sane FROM part")
def p7(spark, d):
    from ..functions.media import sane

    x = br.read(spark, d, "part")
    return x.select(F.col("p_partkey").alias("id"), sane(F.col("p_size") * 1500, F.col("p_size") * 1500, F.col("p_partkey") % 5 * 90, F.col("p_retailprice").cast("double")).alias("sane"))


@query("p8_reusable_identity", "SELECT c_custkey AS id, size IS NOT NULL AND tag IS NOT NULL AND trim(tag) <> '' AND NOT starts_with(trim(tag), 'blake3-sample-v1:') AS reusable FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS size, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'blake3-sample-v1:x' WHEN 2 THEN 'sha256:y' END AS tag FROM customer)")
def p8(spark, d):
    from ..functions.hashing import reusable

    k = F.col("c_custkey")
    tag = F.when(k % 4 == 0, " ").when(k % 4 == 1, "blake3-sample-v1:x").when(k % 4 == 2, "sha256:y")
    return br.read(spark, d, "customer").select(k.alias("id"), reusable(F.when(k % 3 > 0, k), tag).alias("reusable"))


@query("g21_source_keys", """SELECT c_custkey AS id, sha256('v1' || CASE WHEN size IS NULL THEN '-' ELSE '+' || length(size) || ':' || size END || CASE WHEN tag IS NULL THEN '-' ELSE '+' || length(tag) || ':' || tag END) AS key FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::VARCHAR END AS size, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'sha256:y' END AS tag FROM customer)""")
def g21(spark, d):
    from ..functions.hashing import stable_key

    k = F.col("c_custkey")
    tag = F.when(k % 4 == 0, "").when(k % 4 == 1, "sha256:y")
    return br.read(spark, d, "customer").select(k.alias("id"), stable_key(F.when(k % 3 > 0, k.cast("string")), tag).alias("key"))


@query("n1_binding_keys", """SELECT c_custkey AS id, k AS key, CASE WHEN regexp_matches(k, '^t[0-9]+:s[01]:') THEN regexp_extract(k, '^t([0-9]+):', 1)::BIGINT ELSE 1 END AS generation, regexp_matches(k, '^t[0-9]+:s1:') AS seek_safe, CASE WHEN regexp_matches(k, '^t[0-9]+:s[01]:') THEN regexp_extract(k, '^t[0-9]+:s[01]:(.*)$', 1) ELSE k END AS source
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'old' || c_custkey WHEN 1 THEN 't' || c_custkey || ':s1:a:b' ELSE 't2:s0:' || c_custkey END AS k FROM customer)""")
def n1(spark, d):
    from ..functions.names import binding

    c = F.col("c_custkey")
    k = F.when(c % 3 == 0, F.concat(F.lit("old"), c)).when(c % 3 == 1, F.concat(F.lit("t"), c, F.lit(":s1:a:b"))).otherwise(F.concat(F.lit("t2:s0:"), c))
    g, s, r = binding(k)
    return br.read(spark, d, "customer").select(c.alias("id"), k.alias("key"), g.alias("generation"), s.alias("seek_safe"), r.alias("source"))


@query("n4_error_codes", "SELECT event_type, CASE event_type WHEN 'error' THEN 'storage_full' WHEN 'view' THEN 'cancelled' ELSE 'internal' END AS code, count(*) AS n FROM events GROUP BY 1, 2")
def n4(spark, d):
    from ..functions.names import error_code

    m = F.when(F.col("event_type") == "error", "write failed: No space left on device").when(F.col("event_type") == "view", "operation cancelled").otherwise("boom")
    return br.read(spark, d, "events").select("event_type", error_code(m).alias("code")).groupBy("event_type", "code").agg(F.count("*").alias("n"))


@query("n3_envelopes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events")
def n3(spark, d):
    from ..functions.names import envelope

    e = br.read(spark, d, "events")
    line = envelope(F.col("event_type") != "error", F.struct(F.col("event_type").alias("kind")), F.lit("internal"))
    j = e.select("event_id", F.from_json(line, "status string, data struct<kind:string>, code string").alias("j"))
    return j.select("event_id", "j.status", F.col("j.data.kind").alias("kind"))


@query("n5_last_wins", "SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS value FROM orders GROUP BY 1")
def n5(spark, d):
    return br.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderkey", "o_orderkey").alias("value"))


@query("n6_progress_wire", "SELECT user_id, event_id, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def n6(spark, d):
    e = br.read(spark, d, "events").select("user_id", "event_id", F.from_json("props", "k long").k.alias("k")).filter("k >= 10")
    return e.groupBy("user_id").agg(F.max(F.struct("event_id", "k")).alias("x")).select("user_id", "x.event_id", "x.k")


@query("s11_history_json", "SELECT count(*) AS records, count(*) FILTER (c_custkey % 5 <> 0) AS good FROM customer")
def s11(spark, d):
    from ..sources.history import read_history

    c = br.library(spark, d).select("id", "uri", "opened_ms")
    bad = F.col("uri").isNull()
    item = F.when(bad, F.lit('{"id": 5, "lastOpened": "never"}')).otherwise(F.to_json(F.struct("id", "uri", F.col("opened_ms").alias("lastOpened"))))
    docs = c.select(F.format_string('{"version":2,"items":[%s]}', item).alias("value"))
    r = read_history(docs)
    return r.agg(F.count("*").alias("records"), F.count_if(F.col("valid")).alias("good"))


# Caches

@query("st9_lru")
def st9(spark, d):
    return ca.simulate(br.access_log(spark, d), "lru", 160)


@query("st9_lru_closed_form", """SELECT x.cache, x.seq, x.key, x.size, x.prev IS NOT NULL AND coalesce((SELECT sum(s) FROM (SELECT y.key, max(y.size) AS s FROM log y WHERE y.cache = x.cache AND y.seq > x.prev AND y.seq < x.seq GROUP BY 1)), 0) + x.size <= 160 AS hit
    FROM (SELECT *, lag(seq) OVER (PARTITION BY cache, key ORDER BY seq) AS prev FROM log) x""", LOG)
def st9c(spark, d):
    return ca.lru_hits(br.access_log(spark, d), 160)


@query("t6_lru_counters")
def t6(spark, d):
    return ca.counters(ca.simulate(br.access_log(spark, d), "lru", 100))


@query("t7_preview_lru")
def t7(spark, d):
    return ca.simulate(br.access_log(spark, d), "lru", 200, 20)


@query("t8_disk_fifo")
def t8(spark, d):
    return ca.simulate(br.access_log(spark, d), "fifo", 160)


@query("a8_cache_counters", """SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, sum(CASE WHEN NOT hit THEN size END)::BIGINT AS bytes_loaded FROM (SELECT x.*, x.prev IS NOT NULL AND coalesce((SELECT sum(s) FROM (SELECT y.key, max(y.size) AS s FROM log y WHERE y.cache = x.cache AND y.seq > x.prev AND y.seq < x.seq GROUP BY 1)), 0) + x.size <= 160 AS hit
    FROM (SELECT *, lag(seq) OVER (PARTITION BY cache, key ORDER BY seq) AS prev FROM log) x)""", LOG)
def a8(spark, d):
    return ca.counters(ca.simulate(br.access_log(spark, d), "lru", 160))


@query("st10_cursor_reuse", "SELECT source_key AS session, event_id AS seq, luma AS frame_id, coalesce(luma - p > 0 AND luma - p <= 48, false) AS reused, CASE WHEN luma - p > 0 AND luma - p <= 48 THEN luma - p END AS frames_decoded FROM (SELECT *, lag(luma) OVER (PARTITION BY source_key ORDER BY event_id) AS p FROM frames)", FRAMES)
def st10(spark, d):
    f = br.frames(spark, d).select(F.col("source_key").alias("session"), F.col("event_id").alias("seq"), F.col("luma").alias("frame_id"))
    return ca.cursor_reuse(f)


@query("st14_prefetch")
def st14(spark, d):
    f = br.frames(spark, d).select(F.col("source_key").alias("session"), F.col("event_id").alias("seq"), F.col("luma").alias("frame_id"), F.lit(200).cast("long").alias("frame_count"), (F.col("event_id") * 2).alias("done_ms"))
    return ca.prefetch(f)


@query("st11_tiered_lookup", "SELECT seq, key, CASE WHEN key % 3 = 0 THEN 'ram' WHEN key % 5 = 0 THEN 'disk' ELSE 'decode' END AS tier FROM log", LOG)
def st11(spark, d):
    x = br.access_log(spark, d).select("seq", "key")
    k = x.select("key").distinct()
    return ca.tiered(x, k.filter("key % 3 = 0"), k.filter("key % 5 = 0"))


@query("t9_best_fit", "SELECT p_partkey AS request, p_size::BIGINT AS need, arg_min(b, (c, b)) AS buffer, min(c) AS capacity FROM part LEFT JOIN (SELECT i AS b, i * 7 % 45 AS c FROM range(12) t(i)) ON c >= p_size GROUP BY 1, 2")
def t9(spark, d):
    pool = spark.range(12).select(F.col("id").alias("buffer"), (F.col("id") * 7 % 45).alias("capacity"))
    return ca.best_fit(br.read(spark, d, "part").select(F.col("p_partkey").alias("request"), F.col("p_size").cast("long").alias("need")), pool)


@query("st8_request_gate")
def st8(spark, d):
    from ..streaming.gate import replay

    return replay(br.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("event_id").alias("target")))


#: The samples of a slider with what each step says, and the fold over the last admitted one.
SCRUB = f"""{FRAMES}, s AS (SELECT source_key AS session, event_id AS seq, greatest(least((luma / 200.0)::FLOAT, 1::FLOAT), 0::FLOAT) AS x, luma::BIGINT AS target, event_id::BIGINT * 1000000 AS tm,
  row_number() OVER (PARTITION BY source_key ORDER BY event_id) AS k FROM frames),
d AS (SELECT *, x - lag(x) OVER w AS step, greatest(tm - lag(tm) OVER w, 0) AS gone FROM s WINDOW w AS (PARTITION BY session ORDER BY k)),
y AS (SELECT *, CASE WHEN step > 0.00001::FLOAT THEN 1 WHEN step < -0.00001::FLOAT THEN -1 END AS way, CASE WHEN gone > 0 THEN abs(step)::DOUBLE * 1000000000.0 / gone ELSE 0 END AS pace FROM d),
z AS (SELECT *, CASE WHEN pace >= 1.5 THEN 50000000 WHEN pace >= 0.35 THEN 32000000 ELSE 16000000 END AS wait,
  coalesce(way <> last_value(way IGNORE NULLS) OVER (PARTITION BY session ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS turned FROM y),
r AS (SELECT session, seq, k, CASE WHEN session > 0 THEN 'now' ELSE 'none' END AS plan, 0::BIGINT AS wait_ms, x AS ax, target AS atarget, tm AS aat FROM z WHERE k = 1
  UNION ALL SELECT session, seq, k, plan, CASE WHEN plan = 'later' THEN greatest(1, (greatest(1, least(wait, CASE WHEN jump THEN 32000000 ELSE wait END) - since) + 999999) // 1000000) ELSE 0 END,
    CASE WHEN plan = 'now' THEN x ELSE ax END, CASE WHEN plan = 'now' THEN target ELSE atarget END, CASE WHEN plan = 'now' THEN tm ELSE aat END
  FROM (SELECT *, CASE WHEN session <= 0 OR target = atarget THEN 'none' WHEN since >= wait OR turned AND since >= 12000000 OR jump AND since >= 32000000 THEN 'now' ELSE 'later' END AS plan
    FROM (SELECT z.*, r.ax, r.atarget, r.aat, greatest(0, z.tm - r.aat) AS since, abs(z.x - r.ax) >= 0.1::FLOAT AS jump FROM r JOIN z ON z.session = r.session AND z.k = r.k + 1)))"""


@query("st13_admission", "SELECT session, seq, plan, wait_ms FROM r", f"RECURSIVE {SCRUB}")
def st13(spark, d):
    from ..streaming.gate import admit

    f = br.frames(spark, d)
    return admit(f.select(F.col("source_key").alias("session"), F.col("event_id").alias("seq"), (F.col("luma") / 200.0).alias("fraction"), F.col("luma").alias("target"), (F.col("event_id") * 1_000_000).alias("at")))


