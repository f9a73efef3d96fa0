"""Files as addressable lines, with excerpt hashes and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_lines(text: Column) -> Column:
    """Array of a text's lines with their line ends; null and empty texts give an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line: keys, line_no (from 1), line without its line end."""
    one = df.select(*keys, F.posexplode(kept_lines(F.col(text))).alias("at", "raw"))
    return one.select(*keys, (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", "\r?\n$", "").alias("line"))


def excerpt_hash(text: Column, start: Column, end: Column) -> Column:
    """sha256: and the hash of lines start to end (from 1, both included); an end before the start counts as the start."""
    upto = F.greatest(end, start)
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.slice(kept_lines(text), start, upto - start + 1), ""), 256))


def evidence(repo: Column, path: Column, text: Column, start: Column, end: Column, detector: str) -> Column:
    """Evidence struct: where a fact was read and the hash of what stood there."""
    upto = F.greatest(end, start)
    return F.struct(
        repo.alias("repo"), path.alias("path"), start.alias("start"), upto.alias("end"), excerpt_hash(text, start, end).alias("excerpt_hash"), F.lit(detector).alias("detector"), F.lit("ast").alias("source_tier")
    )
