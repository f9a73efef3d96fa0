"""Session helpers: settings for local runs, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "16g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from the platform."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`); one of our own only on a local master without it.

    On a cluster a folder of one machine would lose the data with it, so a cluster without the setting is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.match(r"local(?:\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix=f"spark-{os.getpid()}-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably, so that later rounds neither replay it nor depend on one executor's disk."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
