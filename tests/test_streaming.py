"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from timeloom.operators import grouping as gr
from timeloom.streaming import groups as sg


def test_streamed_groups_equal_the_batch(spark, tmp_path):
    rows = [(s, i, (i * 7 + s) % 40) for s in (1, 2) for i in range(60)]
    cols = "source_key long, frame_id long, luma long"
    for k in range(3):
        part = [r for r in rows if r[1] // 20 == k] + ([(s, 60, None) for s in (1, 2)] if k == 2 else [])
        spark.createDataFrame(part, cols).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((tmp_path / f"in/{k}").glob("*.parquet")).rename(tmp_path / f"flat/{k}.parquet")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "flat"))
    q = sg.greedy_groups(stream, "luma", 9500).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("closed").collect()))
    want = sorted(map(tuple, gr.greedy_groups(spark.createDataFrame(rows, cols), "luma", 9500).collect()))
    assert got == want and len(want) > 4


def test_batches_replace_themselves(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        q = sg.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/cp{_}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*")).first()[0] == 5
