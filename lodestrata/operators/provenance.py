"""Evidence checked against the files it was taken from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import normal_relative
from lodestrata.sources.lines import excerpt_hash


def provenance_errors(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence (repo, path, start, end, excerpt_hash and any further columns) with `error`, null where it holds.

    Errors in this order: no path, a path that leaves its root, no such file, a range out of the file's bounds, another
    hash than the lines have now. `files` has repo, path and content, one row a file. A null range counts as out of bounds.
    """
    there = files.select("repo", "path", F.col("content").alias("_content"), F.size(F.regexp_extract_all("content", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))).alias("_n")).withColumn("_there", F.lit(True))
    joined = evidence.join(there, ["repo", "path"], "left")
    path = F.coalesce("path", F.lit(""))
    inside = F.coalesce((F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_n")), F.lit(False))
    error = (
        F.when(path == "", "no path")
        .when(path.startswith("/") | normal_relative(path).isNull(), "path escapes its root")
        .when(F.col("_there").isNull(), "path not found")
        .when(~inside, "lines out of bounds")
        .when(~F.col("excerpt_hash").eqNullSafe(excerpt_hash(F.col("_content"), F.col("start"), F.col("end"))), "hash mismatch")
    )
    return joined.withColumn("error", error).drop("_content", "_n", "_there")
