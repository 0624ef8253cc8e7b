"""Sessions and storage on small tables, empty ones included."""

from pyspark.sql import functions as F

from timeloom.functions import checks
from timeloom.operators import sessions as se

STREAMS = "source_key long, stream_index long, kind string, decodable boolean, is_default boolean, requested long"


def test_streams(spark):
    rows = [
        (1, 0, "video", True, False, None), (1, 1, "video", True, True, None), (1, 2, "video", False, True, None),
        (2, 0, "video", False, True, None), (3, 0, "audio", True, True, None), (4, 0, "video", True, False, 1), (5, 0, "video", False, False, 0), (6, 1, "video", True, False, 1),
    ]
    got = {r[0]: (r[1], r[2]) for r in se.select_streams(spark.createDataFrame(rows, STREAMS)).collect()}
    assert got == {1: (1, None), 2: (None, "unsupported_codec"), 3: (None, "no_video_stream"), 4: (None, "no_video_stream"), 5: (None, "unsupported_codec"), 6: (1, None)}
    assert se.select_streams(spark.createDataFrame([], STREAMS)).count() == 0


def test_cache_drops_the_oldest(spark):
    rows = [(1, "a", 5, 1, False), (1, "b", 5, 2, False), (1, "c", 5, 3, False), (1, "t", 99, 9, True), (2, "x", 50, 1, False), (3, "t", 1, 1, True)]
    got = {r[0]: tuple(r[1:]) for r in se.open_caches(spark.createDataFrame(rows, "cache long, name string, bytes long, modified long, temporary boolean"), 10).collect()}
    assert got == {1: (1, 2, 10, 1), 2: (0, 0, 0, 1), 3: (1, 0, 0, 0)}


def test_clear(spark):
    files = spark.createDataFrame([("index", "a", 1), ("index", "b", 2), ("other", "a", 4)], "category string, source_key string, bytes long")
    asks = spark.createDataFrame([(1, "source", "a"), (2, "all", None), (3, "source", "../a"), (4, "preview", None), (5, "source", None)], "request long, scope string, source_key string")
    got = {r.request: (r.error, r.files, r.bytes) for r in se.clear_reports(files, asks).collect()}
    bad = ("invalid_source_key", None, None)
    assert got == {1: (None, 1, 1), 2: (None, 3, 7), 3: bad, 4: (None, 0, 0), 5: bad}


def test_presentations(spark):
    rows = [(1, 0, 5, 4, 0), (1, 1, 5, 4, 0), (1, 2, 7, 4, 0), (1, 3, 3, None, 0), (1, 4, 3, None, 1)]
    p = se.presentations(spark.createDataFrame(rows, "source_key long, seq long, frame_id long, anchor_frame long, reopens int"))
    assert [(r.seeks, r.decoded, r.distance) for r in p.orderBy("seq").collect()] == [(True, 2, 1), (False, 0, 0), (False, 2, 0), (True, 4, 3), (True, 4, 3)]
    d = se.navigation_diagnostics(p).first()
    assert (d.requested, d.random_seeks, d.warm_hits, d.ram_hits, d.forward_decodes, d.seek_frames) == (5, 3, 1, 1, 2, 7)


def test_selection_faults(spark):
    rows = [("current", 9, 1, None), ("frames", 2, 2, 1), ("times", 3, 2, 1), ("all", None, None, 0), ("all", None, None, None)]
    x = spark.createDataFrame(rows, "k string, a long, b long, n long")
    got = [r[0] for r in x.select(checks.selection_fault(F.col("k"), F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got == [None, None, "times are reversed", "interval isn't positive", "interval isn't positive"]
