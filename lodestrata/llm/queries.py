"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import credentials, handwritten, licenses, mixing, packing, syntax, tokens, truncation
from lodestrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licence_findings(table(spark, folder, "source_files"), table(spark, folder, "project_licenses"), table(spark, folder, "package_licenses"))


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """The licence of every file: its own notice, else its repository's."""
    files = table(spark, folder, "source_files")
    return licenses.file_findings(files, licenses.repo_licences(table(spark, folder, "project_licenses"), files))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.credential_findings(table(spark, folder, "source_files")).select("file_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with its credentials spliced out."""
    return credentials.redacted_files(table(spark, folder, "source_files")).select("file_id", "project", "relative", "content")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.checked_files(table(spark, folder, "source_files")).where("valid = false").select("file_id")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of invalid files per project and language."""
    return syntax.invalid_rates(syntax.checked_files(table(spark, folder, "source_files")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.machine_files(table(spark, folder, "source_files")).select("file_id").distinct()


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Files by reason and by the evidence that showed it, per project."""
    found = handwritten.machine_files(table(spark, folder, "source_files"))
    return found.groupBy("project", "reason", "evidence").agg(F.count("*").alias("n_files"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(tokens.sized_documents(table(spark, folder, "documents")), table(spark, folder, "pack_profiles"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused share per profile."""
    return packing.fill_report(p8_packed(spark, folder), table(spark, folder, "pack_profiles"))


def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.in_order(mixing.mixed_documents(tokens.sized_documents(table(spark, folder, "documents")), table(spark, folder, "mix_targets")))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target weights and shares reached."""
    return mixing.share_report(p9_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated_documents(table(spark, folder, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Cut rate of each source."""
    return truncation.truncation_rates(truncation.truncated_documents(table(spark, folder, "documents")))


QUERIES = {q.__name__: q for q in (p1_found, p1_files, p2_found, p2_redacted, p4_found, p4_rates, p5_found, p5_reasons, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_rates)}
ORACLE: dict[str, str] = {}
