"""Queries over pictures of the frames, and the rules of a stored index, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import index_rules as ir
from ..operators import picture_groups as pg
from . import bridge as br
from .bridge import ANCHORED, FRAMES

QUERIES: dict = {}
ORACLE_SQL: dict = {}

WIDTH, HEIGHT, STRIDE = 11, 9, 48
FAR, LEAST = 3, 9950


def query(name: str, sql: str, ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {sql}"
        return f

    return add


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A scene of four frames has one pattern; every third pixel is lighter by a
    frame's own amount, and padding differs from frame to frame."""
    y, x, c = np.meshgrid(np.arange(HEIGHT), np.arange(WIDTH), np.arange(3), indexing="ij")
    for b in batches:
        s, d, h, e = (b.column(n).to_numpy(zero_copy_only=False)[:, None, None, None] for n in ("s", "d", "height", "event_id"))
        n = len(s)
        out = np.empty((n, HEIGHT, STRIDE), np.uint8)
        out[:] = (e % 251)[:, :, :, 0]
        shade = out[:, :, : 4 * WIDTH].reshape(n, HEIGHT, WIDTH, 4)
        shade[..., :3] = np.minimum(255, (s * (x + 1) * (c + 2) + y * 17) % 256 + np.where((x + y) % 3 == 0, d, 0))
        shade[..., 3] = 255
        out[:, :, : 4 * WIDTH] = shade.reshape(n, HEIGHT, 4 * WIDTH)
        raw = [out[i, :k].tobytes() for i, k in enumerate(h.ravel().tolist())]
        same = [pa.array(np.full(n, v, np.int32)) for v in (WIDTH, STRIDE)]
        yield pa.RecordBatch.from_arrays(
            [b.column("source_key"), b.column("frame_id"), b.column("event_id"), same[0], b.column("height"), same[1], pa.array(raw, pa.binary())],
            ["source_key", "frame_id", "event_id", "width", "height", "stride", "pixels"],
        )


def pictures(spark, d, odd: bool = False) -> DataFrame:
    height = F.when(F.col("frame_id") % 13 == 5, HEIGHT - 1).otherwise(HEIGHT) if odd else F.lit(HEIGHT)
    f = br.frames(spark, d).select(
        "source_key", "frame_id", F.col("event_id").cast("long").alias("event_id"), F.expr("(source_key * 31 + frame_id div 4 * 7) % 251 + 1").alias("s"),
        (F.col("luma") % 10).alias("d"), height.cast("int").alias("height"),
    )
    return f.mapInArrow(_draw, "source_key long, frame_id long, event_id long, width int, height int, stride int, pixels binary")


def _pict(odd: bool) -> str:
    h = f"CASE WHEN frame_id % 13 = 5 THEN {HEIGHT - 1} ELSE {HEIGHT} END" if odd else str(HEIGHT)
    return f"""{FRAMES}, p0 AS (SELECT source_key, frame_id, event_id, (source_key * 31 + frame_id // 4 * 7) % 251 + 1 AS s, luma % 10 AS d, {h} AS h FROM frames),
p1 AS (SELECT source_key, frame_id, event_id, h, list_transform(range(0, 33 * h), lambda i: least(255, (s * (i % 33 // 3 + 1) * (i % 3 + 2) + i // 33 * 17) % 256 + CASE WHEN (i % 33 // 3 + i // 33) % 3 = 0 THEN d ELSE 0 END)) AS rgb FROM p0),
p2 AS (SELECT *, list_transform(range(0, 11 * h), lambda i: (77 * rgb[3 * i + 1] + 150 * rgb[3 * i + 2] + 29 * rgb[3 * i + 3] + 128) >> 8) AS luma FROM p1),
p3 AS (SELECT *, list_transform(range(0, 72), lambda p: luma[(p // 9 * (h - 1) // 7) * 11 + p % 9 * 10 // 8 + 1]) AS g FROM p2),
p4 AS (SELECT *, list_sum(list_transform(range(0, 64), lambda p: CASE WHEN g[p // 8 * 9 + p % 8 + 1] > g[p // 8 * 9 + p % 8 + 2] THEN 1::HUGEINT << p::INTEGER ELSE 0 END)) AS hh FROM p3),
pict AS (SELECT source_key, frame_id, event_id, h, rgb, luma, (CASE WHEN hh >= 9223372036854775808 THEN hh - 18446744073709551616 ELSE hh END)::BIGINT AS gate FROM p4)"""


PICT, ODD = _pict(False), _pict(True)
DIFF = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i])))"
LIKE = f"(10000 - ({DIFF} * 10000 + len({{a}}) * 255 // 2) // (len({{a}}) * 255))::BIGINT"


@query("g4_gate_hash", "SELECT event_id::BIGINT AS event_id, gate AS gate_hash FROM pict", PICT)
def g4(spark, d):
    return pg.gate_hashes(pictures(spark, d), "event_id")


@query("g9_exact_equality", "SELECT event_id::BIGINT AS event_id, min(event_id) OVER w::BIGINT AS class_id, count(*) OVER w AS equals FROM pict WINDOW w AS (PARTITION BY h, rgb)", ODD)
def g9(spark, d):
    return pg.equal_classes(pictures(spark, d, True), "event_id")


@query("g12_hybrid_decision", f"""SELECT id, distance, similarity, CASE WHEN distance IS NULL THEN 'sizes differ' WHEN distance > {FAR} THEN 'hash rejected' WHEN similarity >= {LEAST} THEN 'accepted' ELSE 'pixels rejected' END AS decision,
    coalesce(distance > {FAR} AND similarity >= {LEAST}, false) AS gate_lost
    FROM (SELECT b.event_id::BIGINT AS id, CASE WHEN a.h = b.h THEN bit_count(xor(a.gate, b.gate))::BIGINT END AS distance, CASE WHEN a.h = b.h THEN {LIKE.format(a='a.rgb', b='b.rgb')} END AS similarity
    FROM pict a JOIN pict b ON b.source_key = a.source_key AND b.frame_id = a.frame_id + 1)""", ODD)
def g12(spark, d):
    """Each frame against the one before it."""
    w = Window.partitionBy("source_key").orderBy("frame_id")
    p = pictures(spark, d, True).select("source_key", "frame_id", F.col("event_id").alias("id"), F.struct(*pg.PICTURE).alias("b"))
    return pg.hybrid_analysis(p.withColumn("a", F.lag("b").over(w)).filter("a is not null"), FAR, LEAST)


@query("st1_picture_groups", """SELECT source_key, ordinal, min(frame_id) AS first, max(frame_id) AS last, count(*) AS frames, min(frame_id) AS representative
    FROM (SELECT *, (sum(new) OVER (PARTITION BY source_key ORDER BY frame_id) - 1)::BIGINT AS ordinal FROM (SELECT source_key, frame_id, CASE WHEN rgb IS DISTINCT FROM lag(rgb) OVER (PARTITION BY source_key ORDER BY frame_id) THEN 1 ELSE 0 END AS new FROM pict)) GROUP BY 1, 2""", ODD)
def st1(spark, d):
    return pg.picture_runs(pictures(spark, d, True))


def _greedy(ok: str, score: str, carried: str) -> str:
    """The greedy fold over adjacent frames; ``{a}`` is the first or the last of the group."""
    cols = carried.split()
    take = lambda p: ", ".join(f"{c} AS {p}_{c}" for c in cols)
    keep = ", ".join(f"CASE WHEN ok THEN r_{c} ELSE {c} END" for c in cols)
    return f"""g AS (SELECT source_key, frame_id, {take('r')}, {take('l')}, 0::BIGINT AS ordinal, frame_id AS first, 10000::BIGINT AS low FROM pict WHERE frame_id = 0
    UNION ALL SELECT source_key, frame_id, {keep}, {', '.join(cols)}, CASE WHEN ok THEN ordinal ELSE ordinal + 1 END, CASE WHEN ok THEN first ELSE frame_id END, CASE WHEN ok THEN least(low, s) ELSE 10000 END
    FROM (SELECT f.*, {', '.join(f'g.r_{c}' for c in cols)}, g.ordinal, g.first, g.low, {score.format(a='g.r')} AS s, {ok.format(a='g.l')} AND {ok.format(a='g.r')} AS ok
      FROM g JOIN pict f ON f.source_key = g.source_key AND f.frame_id = g.frame_id + 1))"""


GROUPED = "SELECT source_key, ordinal, first, max(frame_id) AS last, count(*) AS frames, min(low)::INTEGER AS floor FROM g GROUP BY 1, 2, 3"
RGB, LUMA = LIKE.replace("{a}", "{a}_rgb").replace("{b}", "f.rgb"), LIKE.replace("{a}", "{a}_luma").replace("{b}", "f.luma")


@query("st2_picture_groups", GROUPED, f"{PICT}, {_greedy(f'{LUMA} >= {LEAST}', LUMA, 'luma')}", True)
def st2(spark, d):
    return pg.luma_picture_groups(pictures(spark, d), LEAST)


@query("st3_hybrid_groups", GROUPED, f"{PICT}, {_greedy(f'bit_count(xor({{a}}_gate, f.gate)) <= {FAR} AND {RGB} >= {LEAST}', RGB, 'rgb gate')}", True)
def st3(spark, d):
    return pg.hybrid_picture_groups(pictures(spark, d), FAR, LEAST)


# The rules of a stored row: sound rows from the frames, each rule broken somewhere

#: In words of both dialects: columns of a stored row, by the frame and its anchor.
STORED = {
    "keyframe": "CASE WHEN frame_id % 97 = 1 THEN 2 WHEN is_key THEN 1 ELSE 0 END", "corrupt": "CASE WHEN frame_id % 89 = 2 THEN -1 WHEN is_corrupt THEN 1 ELSE 0 END",
    "anchor_kind": "CASE WHEN frame_id % 83 = 3 THEN 2 WHEN frame_id % 37 = 6 THEN 0 WHEN anchor_frame IS NULL THEN 0 ELSE 1 END",
    "ticks": "CASE WHEN frame_id % 41 = 7 THEN NULL ELSE ticks END",
    "ticks_num": "CASE WHEN frame_id % 43 = 8 THEN NULL WHEN frame_id % 47 = 9 THEN 2 WHEN ticks IS NOT NULL THEN 1 END",
    "ticks_den": "CASE WHEN frame_id % 53 = 10 THEN NULL WHEN frame_id % 59 = 11 THEN 7 WHEN ticks IS NOT NULL THEN 1000 END",
    "ticks_us": "CASE WHEN frame_id % 61 = 12 THEN 5 WHEN ticks IS NOT NULL THEN ticks * 1000 END",
    "duration": "CASE WHEN frame_id % 31 = 13 THEN 0 ELSE duration_ticks END",
    "duration_num": "CASE WHEN frame_id % 29 = 14 THEN 1 WHEN frame_id % 67 = 15 THEN 3 WHEN duration_ticks IS NOT NULL THEN 1 END",
    "duration_den": "CASE WHEN frame_id % 27 = 16 THEN NULL WHEN frame_id % 71 = 17 THEN 9 WHEN duration_ticks IS NOT NULL THEN 1000 END",
    "anchor_frame": "CASE WHEN frame_id % 23 = 18 THEN frame_id + 1 WHEN frame_id % 73 = 19 THEN -1 WHEN frame_id % 26 = 20 THEN NULL ELSE anchor_frame END",
    "anchor_ticks": "CASE WHEN frame_id % 35 = 21 THEN 4 ELSE anchor_ticks END",
    "anchor_num": "CASE WHEN frame_id % 33 = 22 THEN NULL WHEN frame_id % 51 = 23 THEN 6 WHEN anchor_ticks IS NOT NULL THEN 1 END",
    "anchor_den": "CASE WHEN frame_id % 57 = 24 THEN NULL WHEN frame_id % 63 = 25 THEN 8 WHEN anchor_ticks IS NOT NULL THEN 1000 END",
    "anchor_us": "CASE WHEN frame_id % 69 = 26 THEN NULL WHEN anchor_ticks IS NOT NULL THEN anchor_ticks * 1000 END",
}
SOUND = "source_key, frame_id, ticks, duration_ticks, anchor_frame, anchor_ticks, keyframe AS is_key, corrupt AS is_corrupt"
RULES_SQL = {
    "keyframe flag": "keyframe NOT IN (0, 1)", "corrupt flag": "corrupt NOT IN (0, 1)", "anchor kind": "anchor_kind NOT IN (0, 1)",
    "ticks without num": "(ticks IS NULL) <> (ticks_num IS NULL)", "ticks without den": "(ticks IS NULL) <> (ticks_den IS NULL)", "ticks without us": "(ticks IS NULL) <> (ticks_us IS NULL)",
    "ticks time base": "ticks IS NOT NULL AND (ticks_num <> 1 OR ticks_den <> 1000)",
    "duration without num": "(duration IS NULL) <> (duration_num IS NULL)", "duration without den": "(duration IS NULL) <> (duration_den IS NULL)",
    "duration value": "duration IS NOT NULL AND (duration <= 0 OR duration_num <> 1 OR duration_den <> 1000)",
    "anchor without num": "(anchor_ticks IS NULL) <> (anchor_num IS NULL)", "anchor without den": "(anchor_ticks IS NULL) <> (anchor_den IS NULL)", "anchor without us": "(anchor_ticks IS NULL) <> (anchor_us IS NULL)",
    "anchor time base": "anchor_ticks IS NOT NULL AND (anchor_num <> 1 OR anchor_den <> 1000)",
    "anchor of none": "anchor_kind = 0 AND (anchor_frame IS NOT NULL OR anchor_ticks IS NOT NULL)",
    "anchor frame": "anchor_kind = 1 AND (anchor_frame IS NULL OR anchor_frame < 0 OR anchor_frame > frame_id)",
    "keyframe not its anchor": "keyframe = 1 AND corrupt = 0 AND (anchor_kind <> 1 OR anchor_frame <> frame_id)",
}
ROWS = (
    f"{FRAMES}, {ANCHORED}, anch AS (SELECT a.*, k.ticks AS anchor_ticks FROM anchored a LEFT JOIN frames k ON k.source_key = a.source_key AND k.frame_id = a.anchor_frame), "
    f"sound AS (SELECT {SOUND} FROM anch), stored AS (SELECT source_key, frame_id, {', '.join(f'{e} AS {n}' for n, e in STORED.items())} FROM sound)"
)


def stored(spark, d) -> DataFrame:
    from ..operators import timeline as tl

    a = tl.anchors(br.frames(spark, d)).selectExpr(*(x.strip() for x in SOUND.split(",")))
    return a.selectExpr("source_key", "frame_id", *(f"{e} AS {n}" for n, e in STORED.items()))


@query("p2_impossible_rows", "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule FROM stored WHERE {r}" for n, r in RULES_SQL.items())
       + f" UNION ALL SELECT 'any rule' FROM stored WHERE {' OR '.join(f'({r})' for r in RULES_SQL.values())}) GROUP BY 1", ROWS)
def p2(spark, d):
    broken = ir.impossible(stored(spark, d), 1, 1000)
    return broken.select(F.explode(F.concat("rules", F.array(F.lit("any rule")))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
