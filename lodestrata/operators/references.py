"""References to records that do not exist: distributed anti-join of distinct foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import citations, slug, strip

KEY = ("service", "kind", "slug")


def bare_reference(column: str, kind: str) -> Column:
    """A reference field that stands for one kind, with or without `Kind/` before the name, as an array of (kind, name).

    Null and blank values give an empty array.
    """
    name = F.regexp_replace(strip(F.col(column)), f"^{kind}/", "")
    named = F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    return F.when(F.length(name) > 0, named).otherwise(F.expr("array()").cast("array<struct<kind:string,name:string>>"))


def prose_references(*columns: str) -> Column:
    """Citations in string or array-of-string columns, as an array of (kind, name)."""
    texts = [F.col(c) for c in columns]
    return F.flatten(F.array(*[citations(t) for t in texts]))


def references(df: DataFrame, src: str, rec_id: str, at: str, refs: Column) -> DataFrame:
    """One row per distinct reference of a record: src, rec_id, service, kind, slug, at."""
    one = df.select(F.lit(src).alias("src"), F.col(rec_id).cast("bigint").alias("rec_id"), "service", F.col(at).alias("at"), F.explode(refs).alias("ref"))
    return one.select("src", "rec_id", "service", F.col("ref.kind").alias("kind"), slug(F.col("ref.name")).alias("slug"), "at").distinct()


def registry_intervals(artifacts: DataFrame) -> DataFrame:
    """Distinct existence intervals [recorded_at, retired_at) per (service, kind, slug); an open end is null.

    Rows without service, kind, name or recorded_at name nothing that could exist and are left out.
    """
    known = artifacts.where("service is not null and kind is not null and name is not null and recorded_at is not null")
    return known.select("service", "kind", slug(F.col("name")).alias("slug"), F.col("recorded_at").alias("from_at"), F.col("retired_at").alias("to_at")).distinct()


def _classed(placed: DataFrame, intervals: DataFrame) -> DataFrame:
    """The distinct keys and times of references that no parent covers, with their class."""
    keys = placed.select(*KEY, "at").distinct()
    p, k = intervals.alias("p"), keys.alias("k")
    same = reduce(lambda a, b: a & b, [F.col(f"k.{c}") == F.col(f"p.{c}") for c in KEY])
    there = same & (F.col("p.from_at") <= F.col("k.at")) & (F.col("p.to_at").isNull() | (F.col("k.at") < F.col("p.to_at")))
    orphans = k.join(p, there, "left_anti")
    spans = intervals.groupBy(*KEY).agg(F.min("from_at").alias("first_at"))
    finding = F.when(F.col("first_at").isNull(), "missing").when(F.col("first_at") <= F.col("at"), "deleted").otherwise("late")
    return orphans.join(spans, list(KEY), "left").select(*KEY, "at", finding.alias("finding"))


def orphan_references(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """References without a parent that exists at their time, classed `missing`, `deleted` or `late`.

    `refs` has src, rec_id, service, kind, slug, at; `intervals` has service, kind, slug, from_at, to_at. Only kinds
    that occur among the parents are references at all. The distinct keys with their times are anti-joined against
    the parents, so a key cited by many records at one time is looked up once. A reference counts as `deleted` if a
    parent existed before, else as `late` if one is recorded afterwards, else as `missing`. Rows with a null time or
    service can't be placed and are no case. Empty parents leave no kinds and so no cases.
    """
    placed = refs.where("at is not null and service is not null").join(intervals.select("kind").distinct(), "kind", "left_semi")
    return placed.join(_classed(placed, intervals), [*KEY, "at"])


def orphan_report(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per source table and month: references, orphans and their classes, joined back to all references.

    References that can't be placed (null service or time) are counted as `n_unplaced` and in nothing else; those
    without a time stand in a row without a month. References and orphans are made once.
    """
    known = refs.join(intervals.select("kind").distinct(), "kind", "left_semi")
    placed = known.where("at is not null and service is not null")
    all_ = placed.join(_classed(placed, intervals), [*KEY, "at"], "left").withColumn("placed", F.lit(True))
    unplaced = known.where("at is null or service is null").withColumns({"finding": F.lit(None).cast("string"), "placed": F.lit(False)})
    return all_.unionByName(unplaced).groupBy("src", F.date_trunc("month", "at").alias("month")).agg(
        F.count_if("placed").alias("n_refs"),
        F.count("finding").alias("n_orphans"),
        *[F.count_if(F.col("finding") == c).alias(f"n_{c}") for c in ("missing", "deleted", "late")],
        F.count_if(~F.col("placed")).alias("n_unplaced"),
    )


def narrative_and_runbook_references(narratives: DataFrame, proposals: DataFrame) -> DataFrame:
    """All references of narratives (prose) and runbook proposals (alert, flow and prose)."""
    prose = F.flatten(F.array(*[F.coalesce(F.transform(c, lambda t: F.coalesce(t, F.lit(""))), F.array(F.lit(""))) for c in ("symptoms", "diagnosis", "remediation")]))
    cited = F.flatten(F.transform(F.concat(prose, F.array(F.coalesce("escalation", F.lit("")))), citations))
    of_proposal = F.concat(bare_reference("alert_ref", "Alert"), bare_reference("related_flow", "Flow"), cited)
    return references(narratives, "narratives", "narrative_id", "checked_at", citations(F.col("body"))).unionByName(
        references(proposals, "runbook_proposals", "proposal_id", "drafted_at", of_proposal)
    )
