"""Time, pixels, policies, names, sources and stores."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.functions import hashing, names, pixels as px, policy
from timeloom.functions import timebase as tb
from timeloom.operators import cache as ca
from timeloom.operators import library as li
from timeloom.operators import similarity as si
from timeloom.operators import telemetry as te
from timeloom.sources import container, decoded, history, store
from timeloom.streaming import gate


@pytest.mark.parametrize("ticks, num, den, want", [(90000, 1, 90000, 1_000_000), (-1, 1, 3, -333_333), (2**63 - 1, 2**31 - 1, 2**31 - 1, None), (2**63 - 1, 1, 1_000_000, 2**63 - 1), (None, 1, 2, None), (-(2**63), 1, 1_000_000, -(2**63))])
def test_ticks_to_us(spark, ticks, num, den, want):
    df = spark.createDataFrame([(ticks, num, den)], "t long, n long, d long")
    assert df.select(tb.ticks_to_us(F.col("t"), F.col("n"), F.col("d"))).first()[0] == want


def test_bounded_arithmetic(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).first()[0]
    big = F.lit(tb.I64_MAX)
    assert ask(tb.saturating_add(big, F.lit(5).cast("long"))) == tb.I64_MAX
    assert ask(tb.step_target(F.lit(3).cast("long"), F.lit(-tb.I64_MAX), F.lit(9).cast("long"))) == 0
    assert ask(tb.half_up(F.lit(1), F.lit(3))) == 3333 and ask(tb.half_up(F.lit(2), F.lit(3))) == 6667 and ask(tb.half_up(F.lit(2), F.lit(0))) is None
    assert ask(tb.seconds_to_us(F.lit("1.000001"))) == 1_000_001 and ask(tb.seconds_to_us(F.lit("1.0000001"))) is None and ask(tb.seconds_to_us(F.lit("x"))) is None
    assert ask(tb.format_timestamp(F.lit(-3_723_000_004))) == "-1:02:03.000004"
    assert ask(tb.us_of(F.lit(7).cast("long"), 1, 3)) == 2_333_333


def checker(w, h, cell=8):
    y, x = np.mgrid[:h, :w]
    img = np.full((h, w, 4), 255, np.uint8)
    img[..., 0], img[..., 1], img[..., 2] = x * 255 // w, ((x // cell + y // cell) % 2) * 200, y * 255 // h
    return img


def describe(img):
    return np.frombuffer(px.descriptor(img), np.uint8).reshape(16, 16, 3)


def likeness(a, b):
    return int(px.confirm(describe(a)[None], describe(b)[None])[0])


def test_near_duplicates_are_confirmed_and_others_not():
    base = checker(64, 48)
    assert likeness(base, base) == 10000
    assert likeness(base, px.preview(base, 40)) >= 9300
    assert likeness(base, base // 8 * 8) >= 9300
    assert likeness(base, base[2:46, 3:61]) >= 9300
    assert likeness(base, base[..., [1, 2, 0, 3]]) < 9300
    noise = np.random.default_rng(1).integers(0, 256, (48, 64, 4), dtype=np.uint8)
    assert likeness(base, noise) < 9300


def test_picture_rules():
    rows = bytes(range(8)) + bytes(4)
    assert px.picture(rows * 2, 2, 2, 12).shape == (2, 2, 4)
    for bad in ((2, 2, 4), (0, 2, 12), (2, 3, 12)):
        with pytest.raises(px.PictureError):
            px.picture(rows * 2, *bad)
    a = checker(16, 16)
    b = a.copy()
    b[..., 3] = 0
    assert px.rgb_similarity(a, b) == 10000 and not (a == b).all()
    with pytest.raises(px.PictureError):
        px.rgb_similarity(a, a[:8])


def test_gate_hash_of_gradients():
    g = np.repeat((np.arange(9) * 20)[None, :, None], 8, 0).repeat(4, 2).astype(np.uint8)
    assert px.gate_hash(g) == 0 and px.gate_hash(g[:, ::-1]) == -1
    assert px.hybrid(g, g[:, ::-1]) == "hash rejected" and px.hybrid(g, g) == "accepted"


def test_png_round_trip():
    img = checker(5, 3)
    data = px.encode_png(img)
    at, raw = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        raw += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    assert (np.frombuffer(zlib.decompress(raw), np.uint8).reshape(3, 21)[:, 1:].reshape(3, 5, 4) == img).all()


def test_preview_sizes():
    assert px.preview_size(640, 480, 100) == (100, 75) and px.preview_size(10, 20, 100) == (10, 20) and px.preview_size(1000, 1, 10) == (10, 1)


def test_similar_frames_rank(spark):
    imgs = [checker(64, 48)] + [np.random.default_rng(k).integers(0, 256, (48, 64, 4), dtype=np.uint8) for k in range(6)] + [checker(64, 48)]
    imgs[2] = imgs[0] // 4 * 4
    rows = [(k, 64, 48, 256, i.astype(np.uint8).tobytes()) for k, i in enumerate(imgs)]
    d = si.with_bucket(si.describe(spark.createDataFrame(rows, "frame_id long, width int, height int, stride int, pixels binary")))
    got = si.similar_frames(d, d.filter("frame_id = 0")).orderBy("rank").collect()
    assert [(r["frame_id"], r["similarity"]) for r in got][0] == (7, 10000) and 2 in [r["frame_id"] for r in got] and not got[0]["truncated"]
    assert si.incomplete(si.keys(d)).count() == 0


def test_fnv_and_keys(spark):
    assert hashing.fnv1a([]) == 0xCBF29CE484222325
    assert hashing.fnv1a([0x6F6F66]) == hashing.fnv1a([0x6F6F66]) != hashing.fnv1a([1])
    df = spark.createDataFrame([("a", None), ("", "a"), (None, "a"), ("a", "")], "x string, y string")
    assert df.select(hashing.stable_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == 4


def test_bindings_and_codes(spark):
    df = spark.createDataFrame([("t3:s1:a:b",), ("plain",), ("t2:s9:x",)], "k string")
    g, s, r = names.binding(F.col("k"))
    assert [tuple(x) for x in df.select(g, s, r).collect()] == [(3, True, "a:b"), (1, False, "plain"), (1, False, "t2:s9:x")]
    assert spark.range(1).select(names.error_code(F.lit("ENOSPC: x"))).first()[0] == "storage_full"


def test_gate():
    g = policy.Gate()
    assert [g.submit(1), g.submit(2), g.submit(3), g.finish(), g.invalidate(), g.finish(), g.finish()] == ["started", "queued", "replaced", "shown", "invalidated", "stale", "ignored"]


def test_admission(spark):
    ms = policy.MS
    rows = [  # session, fraction, target, at, plan
        (1, 0.1, 10, 0, "now"), (1, 0.1, 10, ms, "none"), (1, 0.101, 11, 2 * ms, "later"), (1, 0.2, 20, 200 * ms, "now"),
        (1, 0.3, 30, 232 * ms, "now"), (1, 0.2, 20, 245 * ms, "now"), (1, 0.25, 25, 250 * ms, "later"), (1, float("nan"), 25, 251 * ms, "none"), (1, 0.25, 25, 252 * ms, "now"),
        (0, 0.2, 20, 0, "none"), (2, 2.0, 5, 0, "now"), (2, 1.5, 6, 15 * ms, "later"), (2, 1.5, 6, 16 * ms, "now"),
    ]
    df = spark.createDataFrame([(s, k, f, t, at) for k, (s, f, t, at, _) in enumerate(rows)], "session long, seq long, fraction double, target long, at long")
    got = {r["seq"]: r for r in gate.admit(df).collect()}
    assert [got[k]["plan"] for k in range(len(rows))] == [r[4] for r in rows]
    assert got[2]["wait_ms"] == 30 and got[11]["wait_ms"] == 1 and got[6]["wait_ms"] == 45  # 1 a second waits 32 ms, 10 a second 50
    # 0.1 away is a jump in 32-bit floats
    two = spark.createDataFrame([(1, 0, 0.2, 1, 0), (1, 1, 0.3, 2, 33 * ms)], "session long, seq long, fraction double, target long, at long")
    assert [r["plan"] for r in gate.admit(two).orderBy("seq").collect()] == ["now", "now"]


def test_eta(spark):
    def left(rates, covered, duration, observed):
        df = spark.createDataFrame([([float(m) for m, _ in rates], [float(x) for _, x in rates], covered, duration, observed)], "m array<double>, d array<double>, c long, t long, o long")
        return tuple(df.select(*te.time_left(*(F.col(c) for c in "mdcto"))).first())

    rates = [(2.0, 30.0)] * 4
    assert left(rates, 5_000_000, 10_000_000, 2000) == (3, 3)
    assert left(rates[:3], 5_000_000, 10_000_000, 2000) == (None, None)
    assert left(rates, 5_000_000, 10_000_000, 900) == (None, None)
    assert left([*rates, (9.0, 30.0)], 5_000_000, 10_000_000, 2000) == (None, None)
    assert left(rates, 9_990_000, 10_000_000, 2000) == (None, None)
    assert left(rates, 5_000_000, None, 2000) == left(rates, None, 10_000_000, 2000) == (None, None)
    assert left([(1.0, 30.0), (1.2, 30.0), (1.1, 1.0), (1.0, 30.0)], 5_000_000, 10_000_000, 2000) == (None, None)


def test_caches(spark):
    c = ca.Lru(10)
    assert [c.touch(k, s) for k, s in (("a", 6), ("b", 4), ("a", 6), ("c", 4), ("b", 4), ("d", 11))] == [(False, 0), (False, 0), (True, 0), (False, 1), (False, 1), (False, 0)]
    f = ca.Fifo(10)
    assert [f.touch(k, 5)[0] for k in "abaca"] == [False, False, True, False, False]
    log = spark.createDataFrame([(k % 3, k, k * k % 17 % 5, k * k % 17 % 5 % 4 + 1) for k in range(300)], "cache long, seq long, key long, size long")
    a = {(r["seq"]): r["hit"] for r in ca.simulate(log, "lru", 9).collect()}
    assert a == {r["seq"]: r["hit"] for r in ca.lru_hits(log, 9).collect()} and any(a.values())


def test_library(spark):
    cols = "id string, uri string, opened_ms long, position long"
    df = spark.createDataFrame([("a", "u1", 5, 0), ("a", "u2", 9, 1), ("b", None, 7, 2), ("c", "u3", 8, 3)], cols)
    assert [r["id"] + r["uri"] for r in li.normalise(df).collect()] == ["cu3", "au1"]
    got = [tuple(r) for r in spark.createDataFrame([("x/../y",), ("ok",), ("",), ("/a",)], "p string").select(li.safe_path(F.col("p")), li.safe_key(F.col("p"))).collect()]
    assert got == [(False, False), (True, True), (False, False), (False, False)]


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(kind=b"vide"):
    mvhd = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2500) + bytes(80))
    tkhd = box(b"tkhd", bytes(40) + struct.pack(">9i", 0, 65536, 0, -65536, 0, 0, 0, 0, 1 << 30) + struct.pack(">II", 640 << 16, 480 << 16))
    mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", 30000, 75000) + bytes(4))
    hdlr = box(b"hdlr", bytes(8) + kind + bytes(12))
    stsz = box(b"stsz", bytes(4) + struct.pack(">II", 0, 75))
    return box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", tkhd + box(b"mdia", mdhd + hdlr + box(b"minf", box(b"stbl", stsz)))))


def test_container_probe(spark, tmp_path):
    assert container.probe(movie()) == {"duration_us": 2_500_000, "width": 640, "height": 480, "rotation": 90, "frames": 75, "fps": 30.0}
    for name, data in (("good.mp4", movie()), ("sound.mp4", movie(b"soun")), ("cut.mp4", movie()[:60])):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in container.inspect(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["good.mp4"] is None and got["sound.mp4"] == "no video track" and got["cut.mp4"]


def test_decoded_source(spark):
    decoded.register(spark)
    df = spark.read.format("decoded_frames").option("frames", 70).option("sources", 2).option("framesPerTask", 30).load()
    assert df.count() == 140 and df.filter("keyframe").count() == 6


def test_history(spark):
    lines = ['{"version":2,"items":[{"id":"a","lastOpened":5},{"id":"b"},3]}', '[{"id":"c","lastOpened":1}]', "{", None]
    got = history.read_history(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["id"], r["valid"]) for r in got if r["id"]) == [("a", True), ("b", False), ("c", True)]
    back = history.write_history(spark.createDataFrame([("a", 5), ("b", 9)], "id string, lastOpened long")).first()[0]
    assert back.index('"b"') < back.index('"a"')


def test_store(spark, tmp_path):
    s = store.FrameStore(spark, f"file://{tmp_path}/s", "k", "id1")
    frames = lambda a, b: spark.range(a, b).withColumnRenamed("id", "frame_id")
    assert s.open().disposition == "created"
    assert s.append(frames(0, 10)) == 10 and s.append(frames(10, 15)) == 15
    with pytest.raises(store.StoreError):
        s.append(frames(16, 18))
    assert s.open().disposition == "recovered"
    s.truncate(12)
    assert s.frames().count() == 12 and s.append(frames(12, 20)) == 20
    s.mark("complete")
    assert s.open().disposition == "reused" and s.meta()["frame_count"] == 20
    with pytest.raises(store.StoreError):
        s.append(frames(20, 21))
    other = store.FrameStore(spark, f"file://{tmp_path}/s", "k", "id2")
    assert other.open().disposition == "rebuilt-identity" and other.meta()["indexed_frames"] == 0
    path = f"file://{tmp_path}/t"
    build = lambda: frames(0, 3)
    assert store.open_or_build(spark, path, lambda d: d.count() == 3, build)[1] == "built"
    assert store.open_or_build(spark, path, lambda d: d.count() == 3, build)[1] == "reused"
