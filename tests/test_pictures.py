"""Picture groups: padding, sizes, order; rules of stored rows one by one."""

import numpy as np
import pytest

from timeloom.functions import pixels as px
from timeloom.operators import index_rules as ir
from timeloom.operators import picture_groups as pg

SCHEMA = "source_key long, frame_id long, width int, height int, stride int, pixels binary"


def row(frame, value, pad=0, height=8, source=1):
    img = np.full((height, 9 * 4 + pad), 200 + frame, np.uint8)
    img[:, : 9 * 4] = value
    return source, frame, 9, height, 36 + pad, bytearray(img.tobytes())


def frames(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def spans(df):
    return [(r["first"], r["last"], r["floor"]) for r in df.orderBy("source_key", "ordinal").collect()]


def test_padding_never_counts(spark):
    f = frames(spark, row(0, 10), row(1, 10, 4), row(2, 10, 12), row(3, 11))
    assert [(r["first"], r["last"]) for r in pg.picture_runs(f).orderBy("ordinal").collect()] == [(0, 2), (3, 3)]
    assert {(r.frame_id, r.class_id, r["equals"]) for r in pg.equal_classes(f, "frame_id").collect()} == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 3, 1)}
    assert spans(pg.hybrid_picture_groups(f, 8, 10000)) == [(0, 2, 10000), (3, 3, 10000)]


def test_drift_away_from_the_first(spark):
    # each is like the one before, the third no longer like the first
    f = frames(spark, row(0, 100), row(1, 105), row(2, 110))
    assert spans(pg.hybrid_picture_groups(f, 8, 9700)) == [(0, 1, 9804), (2, 2, 10000)]
    assert spans(pg.luma_picture_groups(f, 9700)) == [(0, 1, 9804), (2, 2, 10000)]


def test_no_frames(spark):
    f = frames(spark)
    assert pg.hybrid_picture_groups(f).count() == pg.luma_picture_groups(f).count() == pg.picture_runs(f).count() == 0


@pytest.mark.parametrize("bad", [[row(0, 1), row(2, 1)], [row(0, 1), row(1, 1, height=9)], [row(0, 1), (1, 1, 9, 8, 36, bytearray(5))]])
def test_broken_frames_fail(spark, bad):
    with pytest.raises(Exception, match="frame 2 after 0|sizes differ|5 bytes"):
        pg.hybrid_picture_groups(frames(spark, *bad)).collect()


def test_gate_goes_first(spark):
    ramp = np.zeros((8, 9, 4), np.uint8)
    ramp[..., :3] = (np.arange(9) * 2)[None, :, None]
    pair = [(9, 8, 36, bytearray(ramp.tobytes())), (9, 8, 36, bytearray(ramp[:, ::-1].tobytes()))]
    p = spark.createDataFrame([(7, *pair)], "id long, a struct<width:int,height:int,stride:int,pixels:binary>, b struct<width:int,height:int,stride:int,pixels:binary>")
    got = pg.hybrid_analysis(p, 8, 9000).first()
    assert (got.distance, got.decision, got.gate_lost) == (64, "hash rejected", True)
    assert got.similarity == px.rgb_similarity(ramp, ramp[:, ::-1])


SOUND = dict(
    frame_id=5, keyframe=0, corrupt=0, anchor_kind=1, ticks=9, ticks_num=1, ticks_den=1000, ticks_us=9000, duration=2, duration_num=1, duration_den=1000,
    anchor_frame=3, anchor_ticks=4, anchor_num=1, anchor_den=1000, anchor_us=4000,
)


@pytest.mark.parametrize(
    "change, rules",
    [
        ({}, []), ({"keyframe": 2}, ["keyframe flag"]), ({"keyframe": None}, []), ({"ticks_us": None}, ["ticks without us"]),
        ({"ticks": None, "ticks_num": None, "ticks_den": None, "ticks_us": None}, []), ({"duration": 0}, ["duration value"]),
        ({"duration_den": 999}, ["duration value"]), ({"anchor_frame": 6}, ["anchor frame"]), ({"anchor_kind": 0}, ["anchor of none"]),
        ({"keyframe": 1}, ["keyframe not its anchor"]), ({"keyframe": 1, "corrupt": 1}, []), ({"anchor_num": 2}, ["anchor time base"]),
    ],
)
def test_rules_of_stored_rows(spark, change, rules):
    rows = spark.createDataFrame([tuple((SOUND | change).values())], ", ".join(f"{k} long" for k in SOUND))
    got = ir.impossible(rows, 1, 1000).collect()
    assert [x for r in got for x in r.rules] == rules
