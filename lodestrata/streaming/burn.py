"""Streaming twins of the window queries, for event streams with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.windows import BURN_WINDOWS


def event_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with `ts` as an instant."""
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def error_windows(events: DataFrame, key: str, bad: Column, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per key and tumbling window: events and bad ones. Rows later than `late` are left out; state ends with the watermark."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("errors")).select(key, F.col("w.start").alias("start_at"), "n", "errors")


def burn_windows(events: DataFrame, key: str, bad: Column, budget: float, late: str = "10 minutes") -> DataFrame:
    """Sliding long windows of each burn rate with the bad share in them and in their last confirming stretch.

    A streaming frame can't look back from each row, so every rate gets sliding windows that advance by its short
    window; an alert fires where both shares exceed factor times budget.
    """
    out = None
    for name, (long, short, factor) in BURN_WINDOWS.items():
        w = F.window("ts", f"{long} seconds", f"{short} seconds")
        fresh = F.col("ts") >= F.col("w.end") - F.expr(f"interval {short} seconds")
        slid = events.withWatermark("ts", late).select(key, "ts", bad.alias("bad"), w.alias("w")).withColumn("fresh", fresh)
        per = slid.groupBy(key, "w").agg(F.avg(F.col("bad").cast("double")).alias("long_share"), F.avg(F.when(F.col("fresh"), F.col("bad").cast("double"))).alias("short_share"))
        one = per.select(F.lit(name).alias("rate"), key, F.col("w.end").alias("end_at"), "long_share", "short_share", ((F.col("long_share") > factor * budget) & (F.col("short_share") > factor * budget)).alias("fires"))
        out = one if out is None else out.unionByName(one)
    return out


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there into an in-memory table and ends; for tests and backfills of small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
