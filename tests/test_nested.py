"""Flat tables of nested records in every delivered shape."""

import json
from datetime import datetime

from lodestrata.operators import nested

STEP = "struct<id:string,name:string,kind:string,symbol:string,failureModes:array<struct<mode:string,surfacedAs:string,dataLossRisk:boolean>>,refs:array<struct<kind:string,name:string,relation:string>>>"
SCHEMA = f"flow_id bigint, steps array<{STEP}>, sinks array<struct<type:string,target:string>>, spec_json string, captured_at timestamp_ntz, ingested_at timestamp_ntz, child string, path string, _doc string"
T = lambda d: datetime(2024, 1, d)


def flow(i, steps=None, sinks=None, spec=None, at=T(1)):
    return (i, steps, sinks, spec if spec is None or isinstance(spec, str) else json.dumps(spec), at, at, "clash", "clash", "clash")


def places(spark, *rows):
    out = nested.flow_children(spark.createDataFrame(list(rows), SCHEMA)).collect()
    return {(r.flow_id, r.child, r.pos, r.sub_pos) for r in out if r.child != "ref"}


def test_native_rows_keep_places_of_null_elements(spark):
    steps = [("s1", "a", "k", None, [("m", None, None), None, ("n", None, True)], None), None, ("s1", "b", None, None, None, [("Alert", "x", "covers")])]
    got = places(spark, flow(1, steps, [None, ("db", "t")]))
    assert got == {(1, "step", 1, 0), (1, "step", 3, 0), (1, "mode", 1, 1), (1, "mode", 1, 3), (1, "sink", 2, 0)}


def test_json_shapes(spark):
    got = places(
        spark,
        flow(1, spec={"spec": {"steps": [{"name": "a", "failure_modes": ["timeout", None]}], "sinks": {"type": "db"}}}),
        flow(2, spec={"steps": {"name": "a", "failureModes": {"mode": "x"}}, "sinks": json.dumps([{"type": "db"}, None, {"type": "q"}])}),
        flow(3, spec={"Steps": json.dumps([{"failureModes": json.dumps([{"mode": "x"}])}]), "sinks": None}),
        flow(4, spec="{broken"),
        flow(5, spec='{"steps": [{}]} trailing'),
        flow(6, spec="[]"),
        flow(7),
        flow(8, spec={"steps": [{"failureModes": None, "failure_modes": ["late"]}, "text", 3]}),
    )
    assert {x for x in got if x[0] == 1} == {(1, "step", 1, 0), (1, "mode", 1, 1), (1, "sink", 1, 0)}
    assert {x for x in got if x[0] == 2} == {(2, "step", 1, 0), (2, "mode", 1, 1), (2, "sink", 1, 0), (2, "sink", 3, 0)}
    assert {x for x in got if x[0] == 3} == {(3, "step", 1, 0), (3, "mode", 1, 1)}
    assert {x for x in got if x[0] == 8} == {(8, "step", 1, 0), (8, "mode", 1, 1), (8, "step", 2, 0), (8, "step", 3, 0)}
    assert {x[0] for x in got} == {1, 2, 3, 8}


def test_latest_row_counts_and_repeats_once(spark):
    new = flow(1, spec={"steps": [{}, {}]}, at=T(9))
    got = places(spark, flow(1, spec={"steps": [{}] * 5}), new, new, (None, *new[1:]))
    assert got == {(1, "step", 1, 0), (1, "step", 2, 0)}
    assert places(spark) == set()


def test_tables_link_to_their_parents(spark):
    steps = [("s1", "a", "k", "sym", [("m", "http", True)], [("Alert", "x", "covers")])]
    flows = nested.uniform_flows(nested.latest_flows(spark.createDataFrame([flow(1, steps, [("db", "t")])], SCHEMA)))
    nodes = nested.dewey_nodes(flows, ["flow_id"], ["steps", "sinks"])
    tables = nested.flat_tables(nodes, ["flow_id"], flows, ["steps", "sinks"])
    step, mode = tables["steps"].first(), tables["steps.failureModes"].first()
    assert (step.name, step.symbol, step.label) == ("a", "sym", [1, 1])
    assert (mode.mode, mode.dataLossRisk, mode.parent_label) == ("m", True, step.label)
    assert tables["steps.refs"].first().parent_label == step.label and tables["sinks"].first().target == "t"
