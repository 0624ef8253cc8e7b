"""Lookups, anchors, selection and groups on small timelines."""

import pytest
from pyspark.sql import functions as F

from timeloom.operators import grouping as gr
from timeloom.operators import selection as sel
from timeloom.operators import timeline as tl

FRAMES = "source_key long, frame_id long, ticks long, duration_ticks long, keyframe boolean, corrupt boolean"


def timeline(spark, times, keys=(0,), corrupt=(), source=1):
    return spark.createDataFrame([(source, i, t, 40, i in keys, i in corrupt) for i, t in enumerate(times)], FRAMES)


def ask(spark, times, *targets):
    f = timeline(spark, times)
    p = spark.createDataFrame([(1, k, t) for k, t in enumerate(targets)], "source_key long, probe_no long, target long")
    rows = lambda df: [r["found"] for r in df.orderBy("probe_no").collect()]
    return rows(tl.asof(f, p, "before")), rows(tl.asof(f, p, "after")), rows(tl.nearest(f, p))


@pytest.mark.parametrize("times, target, before, after, nearest", [
    ([0, 10, 25, 40], 20, 1, 2, 2), ([0, 10, 25, 40], 5, 0, 1, 0), ([0, 10, 25, 40], -1, None, 0, 0), ([0, 10, 25, 40], 41, 3, None, 3),
    ([0, 10, 10, 20], 10, 2, 1, 1), ([None, None], 3, None, None, None), ([5, None, 7], 6, 0, 2, 0),
])
def test_asof_ties(spark, times, target, before, after, nearest):
    assert ask(spark, times, target) == ([before], [after], [nearest])


def test_anchors_segments_and_safety(spark):
    f = timeline(spark, [0, 10, 20, 30, 40, 50], keys=(1, 3, 4), corrupt=(3,))
    assert [r["anchor_frame"] for r in tl.anchors(f).orderBy("frame_id").collect()] == [None, 1, 1, 1, 4, 4]
    assert [(r["first"], r["end"]) for r in tl.segments(f).orderBy("ordinal").collect()] == [(1, 4), (4, 6)]
    assert tl.seek_safety(f).first()["seek_safe"]
    assert not tl.seek_safety(timeline(spark, [0, 0], keys=(0, 1))).first()["seek_safe"]
    assert not tl.seek_safety(timeline(spark, [None, 5], keys=(0,))).first()["seek_safe"]
    assert tl.seek_safety(timeline(spark, [None, 5], keys=())).first()["seek_safe"]


@pytest.mark.parametrize("times, kind", [([0, 40, 80], "constant"), ([0, 40, 125], "variable"), ([0, 40], "unknown"), ([0, 40, 40], "variable")])
def test_cadence(spark, times, kind):
    assert tl.cadence(timeline(spark, times)).first()["cadence"] == kind


def test_reconcile_and_prefix(spark):
    a, b = timeline(spark, [0, 10, None, 30]), timeline(spark, [0, 10, None, 31, 40])
    assert {(r["frame_id"], r["difference"]) for r in tl.reconcile(a, b).collect()} == {(3, "ticks"), (4, "extra")}
    r = tl.prefix_match(a, b).first()
    assert (r["valid_prefix"], r["action"], r["to_write"]) == (3, "rebuild", 5)
    r = tl.prefix_match(timeline(spark, [0, 10]), b).first()
    assert (r["valid_prefix"], r["action"], r["to_write"]) == (2, "append", 3)


def test_plans(spark):
    f = timeline(spark, [40 * i for i in range(100)])
    p = sel.plan(f, sel.Request("all", every_n=10)).first()
    assert (p["first"], p["last"], p["selected"]) == (0, 90, 10)
    p = sel.plan(f, sel.Request("time", 41, 200)).first()
    assert (p["first"], p["last"]) == (2, 5)
    assert sel.plan(f, sel.Request("frames", 5, 100)).count() == 0  # ids aren't clamped
    for bad in (sel.Request("frames", 5, 4), sel.Request("all", every_n=0), sel.Request("current"), sel.Request("x")):
        with pytest.raises(sel.SelectionError):
            sel.plan(f, bad)


def test_time_range_takes_the_interval_of_ids(spark):
    f = timeline(spark, [0, 10, 500, None, 20, 30])
    p = sel.plan(f, sel.Request("time", 5, 25))
    assert [r["frame_id"] for r in sel.execute(f, p).orderBy("frame_id").collect()] == [1, 2, 3, 4]


def test_manifest_ends_failed_when_a_sink_lost_a_frame(spark):
    f = timeline(spark, [0, 10, 20])
    r = sel.Request("all")
    x = sel.execute(f, sel.plan(f, r))
    good = [m["line"] for m in sel.manifest(x, r).orderBy("section", "ordinal").collect()]
    assert len(good) == 5 and '"status":"complete"' in good[-1] and '"file":"frame_00000000000000000002.png"' in good[3]
    lost = [m["line"] for m in sel.manifest(x, r, F.when(F.col("frame_id") < 2, 7)).orderBy("section", "ordinal").collect()]
    assert len(lost) == 4 and '"status":"failed"' in lost[-1]


def luma(spark, values, source=1):
    return spark.createDataFrame([(source, i, v) for i, v in enumerate(values)], "source_key long, frame_id long, luma long")


def spans(df):
    return [(r["first"], r["last"]) for r in df.orderBy("ordinal").collect()]


def test_groups(spark):
    assert spans(gr.greedy_groups(luma(spark, [0, 5, 10]), "luma", 9700)) == [(0, 1), (2, 2)]
    assert spans(gr.exact_runs(luma(spark, [1, 2, 1]), "luma")) == [(0, 0), (1, 1), (2, 2)]
    assert spans(gr.exact_runs(luma(spark, [None, None, 1]), "luma")) == [(0, 1), (2, 2)]
    g = luma(spark, [7, 7, 7, 9]).withColumnRenamed("luma", "value").withColumn("hash", F.when(F.col("frame_id") == 1, 2**40 - 1).otherwise(0))
    assert spans(gr.hybrid_groups(g, 8, 9700)) == [(0, 0), (1, 1), (2, 3)]


def test_group_gap_is_an_error(spark):
    with pytest.raises(Exception, match="after"):
        gr.greedy_groups(luma(spark, [0, 1, 2]).filter("frame_id <> 1"), "luma").collect()


def test_tiling_faults(spark):
    cols = "source_key long, ordinal long, first long, last long, frames long"
    n = spark.createDataFrame([(1, 10)], "source_key long, n long")

    def fault(*groups):
        df = spark.createDataFrame([(1, k, a, b, b - a + 1) for k, (a, b) in enumerate(groups)], cols)
        r = gr.group_faults(df, n).first()
        return r and r["fault"]

    assert fault((0, 4), (5, 9)) is None
    assert fault((0, 4), (6, 9)) == "gap" and fault((0, 4), (4, 9)) == "overlap"
    assert fault((1, 9)) == "late start" and fault((0, 8)) == "early end"
