"""Sinks: facts by type, artifacts by status and kind, file sets with a manifest of hashes, publish merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_facts(facts: DataFrame, folder: str) -> None:
    """Facts as one folder per type; a run replaces only the types it writes."""
    facts.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("type").parquet(folder)


def write_artifacts(artifacts: DataFrame, folder: str) -> None:
    """Artifacts routed by status and kind, overwritten partition by partition, so that a second run changes nothing."""
    artifacts.repartition("status", "kind").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("status", "kind").parquet(folder)


def write_report(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").json(folder)


def manifest(files: DataFrame) -> DataFrame:
    """path and hash of a file set (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def stale(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of the previous manifest that the current one no longer has."""
    return previous.join(current.select("path"), "path", "left_anti").select("path")


def three_way(staged: DataFrame, standing: DataFrame, written: DataFrame) -> DataFrame:
    """What to do with each path: write, propose, remove, keep or nothing, from three manifests (path, hash).

    Ours to overwrite is what still stands as we last wrote it, or what isn't there; anything else was touched by
    someone and is only proposed.
    """
    every = staged.withColumnRenamed("hash", "s").join(standing.withColumnRenamed("hash", "d"), "path", "full").join(written.withColumnRenamed("hash", "m"), "path", "full")
    s, d, m = F.col("s"), F.col("d"), F.col("m")
    action = (
        F.when(s.isNull() & d.isNull(), None).when(s.isNull() & (d == m), "remove").when(s.isNull(), "keep").when(d.isNull() | d.eqNullSafe(m), "write").when(d == s, "same").otherwise("propose")
    )
    return every.select("path", action.alias("action")).where("action is not null")


def colliding_paths(staged: DataFrame) -> DataFrame:
    """Paths that more than one staged file claims."""
    return staged.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
