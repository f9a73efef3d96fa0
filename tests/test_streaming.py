"""Streams over files give what the batch queries give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.streaming import burn


def test_error_windows_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("k", start + timedelta(minutes=m), "error" if m % 3 == 0 else "ok") for m in range(60)] + [("k", start + timedelta(hours=9), "ok")]
    spark.createDataFrame(rows, "key string, ts timestamp_ntz, t string").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = burn.error_windows(burn.event_stream(spark, str(tmp_path / "in")), "key", F.col("t") == "error")
    burn.run_available(stream, "error_windows", str(tmp_path / "c"))
    got = {(r.start_at, r.n, r.errors) for r in spark.table("error_windows").collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).where("ts < '2024-01-01 02:00:00'").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("t") == "error").alias("e"))
    assert got == {(r.w.start, r.n, r.e) for r in batch.collect()} and len(got) == 12


def test_burn_windows_fire_on_a_current_burn(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("k", start + timedelta(minutes=m), "error" if 55 <= m < 60 else "ok") for m in range(120)] + [("k", start + timedelta(days=1), "ok")]
    spark.createDataFrame(rows, "key string, ts timestamp_ntz, t string").repartition(1).write.parquet(str(tmp_path / "in"))
    events = burn.event_stream(spark, str(tmp_path / "in"))
    burn.run_available(burn.burn_windows(events, "key", F.col("t") == "error", 0.005), "burn", str(tmp_path / "c"))
    fired = {r.end_at for r in spark.table("burn").where("rate = 'fast' and fires").collect()}
    assert fired == {start + timedelta(minutes=60)}
