"""Queries over whole tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom import plans
from timeloom.functions import pixels as px
from timeloom.operators import library as li
from timeloom.plans import bridge as br
from timeloom.plans import more_queries as mq
from timeloom.sources import store

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_library_order_of_all(spark):
    records = plans.QUERIES["j11_library_reconcile"](spark, SF).select(li.recency().alias("r"), "id").collect()
    want = sorted((r["id"], k + 1) for k, r in enumerate(sorted(records, key=lambda r: (-r["r"], r["id"]))))
    got = rows(plans.QUERIES["t4_library_order"](spark, SF))
    assert got == want and len(got) > 500


def test_numbering_of_ties_and_nothing(spark):
    df = spark.range(1000).selectExpr("id % 3 as a", "id as b")
    assert rows(li.numbered(df, [df.a, df.b], parts=7, sampled=50)) == [(a, b, k + 1) for k, (a, b) in enumerate(sorted((i % 3, i) for i in range(1000)))]
    assert li.numbered(df.limit(0), [df.a]).count() == 0


@pytest.mark.parametrize("size", [1, 9, 14, 700])
def test_every_frame_is_a_partner(spark, monkeypatch, size):
    ids = sorted(3 * k + 1 for k in range(size))
    monkeypatch.setattr(br, "grid", lambda s, d: s.createDataFrame([(i, [0]) for i in ids], "frame_id long, v array<int>"))
    got = rows(mq.pairs(spark, SF))
    assert [a for a, _ in got] == ids and sorted(b for _, b in got) == ids


def test_pair_queries_of_all(spark):
    v = {r["frame_id"]: list(r["v"]) for r in br.grid(spark, "/root/testdata/sf0.1").collect()}
    got = rows(plans.QUERIES["g11_rgb_similarity"](spark, "/root/testdata/sf0.1"))
    want = {(a, b): 10000 - (3 * sum(abs(x - y) for x, y in zip(v[a], v[b])) * 10000 + 192 * 255 // 2) // (192 * 255) for a, b, _ in got}
    assert len(v) > 500 and sorted(a for a, *_ in got) == sorted(b for _, b, _ in got) == sorted(v)
    assert all(want[a, b] == s for a, b, s in got)
    same = rows(plans.QUERIES["g22_exact_threshold"](spark, "/root/testdata/sf0.1"))
    assert same == sorted((a, b, s == 10000) for a, b, s in got)
    for name in ("g13_translation", "g14_crop_search"):
        x = plans.QUERIES[name](spark, "/root/testdata/sf0.1").select("frame_id").collect()
        assert sorted(r[0] for r in x) == sorted(v)


def test_frames_of_all(spark):
    frames = sorted((r["source_key"], r["frame_id"]) for r in br.frames(spark, SF).collect())
    runs = plans.timeline_queries.runs(spark, SF).collect()
    at = {(r["source_key"], f): r["ordinal"] for r in runs for f in range(r["first"], r["last"] + 1)}
    assert rows(plans.QUERIES["j8_group_of_frame"](spark, SF)) == [(k, f, at.get((k, f))) for k, f in frames]
    anchor = {(r["source_key"], r["frame_id"]): r["anchor_frame"] for r in plans.QUERIES["w3_anchors"](spark, SF).collect()}
    assert rows(plans.QUERIES["j14_nearest_keyframe"](spark, SF)) == [(k, f, anchor[k, f] or 0) for k, f in frames]
    st = {(r["source_key"], r["frame_id"]): (r["decode_from"], r["decoded"]) for r in plans.QUERIES["st12_seek_navigation"](spark, SF).collect()}
    assert sorted(st) == frames and all(s in (0, anchor[x] or 0) and n == x[1] - s + 1 for x, (s, n) in st.items())
    v = {r["frame_id"]: r["v"] for r in br.grid(spark, SF).collect()}
    assert rows(plans.QUERIES["s4_materialise"](spark, SF)) == sorted((k, "".join(f"{x:02X}" * 3 + "FF" for x in w)) for k, w in v.items())


def test_stores_of_many_sources(spark, tmp_path):
    s = store.FrameStores(spark, f"file://{tmp_path}/s", batch=4)
    rows = lambda lo, hi, keys=(1, 2): spark.createDataFrame([(k, i) for k in keys for i in range(lo, hi)], "source_key long, frame_id long")
    s.append(rows(0, 6))
    s.append(rows(6, 10))
    s.append(rows(0, 3, (3,)))
    assert s.frames().groupBy("source_key", "batch").count().count() == 7
    for bad in (rows(11, 12), rows(9, 11), rows(1, 2, (4,)), rows(10, 12).union(rows(10, 11))):
        with pytest.raises(store.StoreError):
            s.append(bad)
    rows(10, 13).withColumn("batch", F.lit(2).cast("long")).write.mode("append").parquet(f"file://{tmp_path}/s/frames-1")  # an append that was lost
    assert s.frames().count() == 23
    s.append(rows(10, 11))
    assert s.frames().count() == 25 and s.frames().distinct().count() == 25
    s.mark("complete", F.col("source_key") == "3")
    assert sorted((m["source_key"], m["lifecycle"], m["indexed_frames"], m["frame_count"]) for m in s.meta().collect()) == [("1", "building", 11, None), ("2", "building", 11, None), ("3", "complete", 3, 3)]
    with pytest.raises(store.StoreError):
        s.append(rows(3, 4, (3,)))
    s.truncate(2)
    assert s.frames().count() == 6 and {m["indexed_frames"] for m in s.meta().collect()} == {2}


def test_confirmation_of_shared_descriptors(spark):
    r = np.random.default_rng(2)
    x, y = (r.integers(0, 256, (n, px.SIDE, px.SIDE, 3)).astype(np.uint8) for n in (5, 30))
    ix, iy = r.integers(0, 5, 200), r.integers(0, 30, 200)
    assert (px.confirm_of(x, ix, y, iy) == px.confirm(x[ix], y[iy])).all()
    # one crop by its definition: bilinear in whole numbers of 1 / 65536
    w, img = px._axis_weights(px.INSETS[-1]), x[0].astype(object)
    want = [[[min(255, (sum(int(w[i, p]) * int(w[j, q]) * img[p, q, c] for p in range(16) for q in range(16)) + (1 << 31)) >> 32) for c in range(3)] for j in range(16)] for i in range(2)]
    assert (px.crops(x[:1])[-1].reshape(16, 16, 3)[:2] == np.array(want, int)).all()
