"""Orphan references against brute force and on untidy rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.text import citations, slug, strip
from lodestrata.operators import references as R

DAY = lambda d: datetime(2024, 1, d)
ARTIFACTS = "service string, kind string, name string, recorded_at timestamp_ntz, retired_at timestamp_ntz, slug string, ref string"
NARRATIVES = "narrative_id bigint, service string, body string, checked_at timestamp_ntz, ref string, at string"
PROPOSALS = "proposal_id bigint, service string, alert_ref string, related_flow string, symptoms array<string>, diagnosis array<string>, remediation array<string>, escalation string, drafted_at timestamp_ntz, kind string"


@pytest.fixture(scope="module")
def artifacts(spark):
    rows = [
        ("a", "Alert", "high-load", DAY(5), DAY(10), "x", "x"),
        ("a", "Alert", "high-load", DAY(5), DAY(10), "x", "x"),
        ("a", "Alert", "high-load", DAY(20), None, "x", "x"),
        ("a", "Flow", "createOrder", DAY(1), None, None, None),
        ("b", "Alert", "high-load", DAY(1), None, None, None),
        (None, "Alert", "nobody", DAY(1), None, None, None),
        ("a", None, "nothing", DAY(1), None, None, None),
        ("a", "Runbook", None, DAY(1), None, None, None),
        ("a", "Flow", "undated", None, None, None, None),
    ]
    return spark.createDataFrame(rows, ARTIFACTS)


def found(spark, artifacts, narratives=(), proposals=()):
    refs = R.narrative_and_runbook_references(spark.createDataFrame(list(narratives), NARRATIVES), spark.createDataFrame(list(proposals), PROPOSALS))
    rows = R.orphan_references(refs, R.registry_intervals(artifacts)).collect()
    return {(r.src[0], r.rec_id, f"{r.kind}/{r.slug}", r.finding) for r in rows}


def test_time_and_class_of_prose_references(spark, artifacts):
    body = "See Alert/high-load, Flow/create_order and TCP/IP; `Flow/gone.` (Alert/other-service)"
    rows = [(i, "a", body, DAY(d), "r", "t") for i, d in ((1, 4), (2, 5), (3, 10), (4, 25))]
    got = found(spark, artifacts, rows)
    assert {x for x in got if "high-load" in x[2]} == {("n", 1, "Alert/high-load", "late"), ("n", 3, "Alert/high-load", "deleted")}
    assert {x[1] for x in got if x[2] == "Flow/gone" and x[3] == "missing"} == {1, 2, 3, 4}
    assert not any("create-order" in x[2] or "TCP" in x[2] for x in got)


def test_reference_fields_and_nulls(spark, artifacts):
    p = lambda i, alert, flow, **k: (i, k.get("service", "a"), alert, flow, k.get("s"), [], [None, "Alert/high-load"], k.get("e"), k.get("at", DAY(6)), "k")
    rows = [
        p(1, " Alert/HighLoad ", "create.order"),
        p(2, "no-such", None, s=["Runbook/x-y"]),
        p(3, "  ", ""),
        p(4, None, None, e="ask Alert/nobody"),
        p(5, "no-such", None, at=None),
        p(6, "no-such", None, service=None),
        p(2, "no-such", None, s=["Runbook/x-y"]),
    ]
    got = found(spark, artifacts, proposals=rows)
    assert got == {("r", 2, "Alert/no-such", "missing"), ("r", 4, "Alert/nobody", "missing")}  # no Runbook is registered, so it is no kind


def test_empty_tables(spark, artifacts):
    assert found(spark, artifacts) == set()
    assert found(spark, artifacts.where("false"), [(1, "a", "Alert/x", DAY(1), "", "")]) == set()


def test_report_counts_all_references(spark, artifacts):
    refs = R.references(spark.createDataFrame([(1, "a", "Alert/gone Flow/create-order", DAY(3), "", "")], NARRATIVES), "n", "narrative_id", "checked_at", citations(F.col("body")))
    report = R.orphan_report(refs, R.registry_intervals(artifacts)).collect()
    assert [(r.n_refs, r.n_orphans, r.n_missing, r.n_deleted, r.n_late, r.n_unplaced) for r in report] == [(2, 1, 1, 0, 0, 0)]
    untimed = refs.withColumn("at", F.lit(None).cast("timestamp_ntz"))
    assert [(r.month, r.n_refs, r.n_orphans, r.n_unplaced) for r in R.orphan_report(untimed, R.registry_intervals(artifacts)).collect()] == [(None, 0, 0, 2)]


@pytest.mark.parametrize("text, want", [("HTTPServer", "h-t-t-p-server"), ("a  b_c", "a-b-c"), ("", "x"), ("--", "x"), ("CreateOrder", "create-order"), (None, None), ("é", "x")])
def test_slug(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(slug(F.col("t"))).first()[0] == want


def test_strip_takes_all_white_space(spark):
    assert spark.createDataFrame([("\t a b  \n",)], "t string").select(strip(F.col("t"))).first()[0] == "a b"
