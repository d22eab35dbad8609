import datetime as dt

from pyspark.sql import functions as F

from wattloom.operators import features as fx
from wattloom.sources import bronze as src
from wattloom.streaming.resample import resample_stream


def test_stream_gives_the_batch_means(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = resample_stream(src.from_events(stream)).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    got = {r["timestamp"]: (r["avg_load"], r["n"]) for r in spark.table("bins").collect()}
    want = fx.resample(src.from_events(batch), 900).withColumn("timestamp", F.timestamp_seconds(F.col("slot") * 900))
    want = {r["timestamp"]: r["avg_load"] for r in want.collect()}
    assert got.keys() == want.keys() and sum(n for _, n in got.values()) == batch.count()
    assert all((got[k][0] is None) == (v is None) and (v is None or abs(got[k][0] - v) < 1e-9) for k, v in want.items())


def test_bins_close_behind_the_watermark_and_late_rows_go(spark, tmp_path):
    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    schema = "series_id string, timestamp timestamp_ntz, load double"
    batches = [
        [("0", at(1), 1.0), ("0", at(2), 3.0), ("0", at(20), 5.0), ("1", at(2), None)],
        [("0", at(50), 7.0), ("0", at(3), 5.0)],  # late by less than an hour: counts
        [("0", at(140), 9.0)],  # the watermark goes to minute 80
        [("0", at(4), 100.0), ("0", at(141), 11.0)],  # late by more: goes
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = resample_stream(stream).writeStream.outputMode("append").format("memory").queryName("closed")
    q = out.option("checkpointLocation", str(tmp_path / "state")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = {(r["series_id"], r["timestamp"]): (r["avg_load"], r["n"]) for r in spark.table("closed").collect()}
    assert got == {("0", at(0)): (3.0, 3), ("0", at(15)): (5.0, 1), ("1", at(0)): (None, 1), ("0", at(45)): (7.0, 1)}  # minute 135's bin is open still
