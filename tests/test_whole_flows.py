"""Queries over flows see those whose spec was delivered as text."""

import json
from datetime import datetime

import pytest

import __spark_entry__ as entry

STEP = "struct<id:string,name:string,kind:string,symbol:string,failureModes:array<struct<mode:string,surfacedAs:string,dataLossRisk:boolean>>,refs:array<struct<kind:string,name:string,relation:string>>>"
SCHEMA = f"flow_id bigint, service string, name string, flow_trigger struct<type:string,method:string,path:string,entrypoint:string>, steps array<{STEP}>, sinks array<struct<type:string,target:string>>, spec_json string, captured_at timestamp_ntz, ingested_at timestamp_ntz"
AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spec = {"spec": {"Trigger": {"type": "http", "path": "/a"}, "steps": [{"name": "s", "symbol": "A#b", "failure_modes": ["timeout"], "refs": {"kind": "Alert", "name": "x", "relation": "covers"}}], "sinks": {"type": "db", "target": "t"}}}
    rows = [
        (1, "one", "f", ("http", None, "/b", None), [("s1", "n", "k", "C#d", None, None)], [("db", "t")], None, AT, AT),
        (2, "two", "g", None, None, None, json.dumps(spec), AT, AT),
        (3, "three", "h", None, None, None, "{broken", AT, AT),
    ]
    at = str(tmp_path_factory.mktemp("flows"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/flows.parquet")
    return at


def rows(spark, folder, name):
    return {tuple(r) for r in entry.queries()[name](spark, folder).collect()}


def test_spec_rows_count(spark, folder):
    assert rows(spark, folder, "AGG-05_blast_radius") == {("db", "t", 2)}
    assert {r[0] for r in rows(spark, folder, "SCL-04_symbols")} == {"A#b", "C#d"}
    assert {(r[0], r[2]) for r in rows(spark, folder, "VAL-01_structure")} == {(1, ""), (2, ""), (3, "trigger,steps")}
    assert rows(spark, folder, "AGG-21_edge_first") == {("two", "Alert", "x", "covers", 2)}
    assert {r[0] for r in rows(spark, folder, "AGG-33_catalog")} == {"one", "two"}
    assert rows(spark, folder, "WIN-03_step_numbers") == {(1, AT, 1, "s1"), (2, AT, 1, "s1")}


def test_old_versions_and_repeats_count_once(spark, folder, tmp_path):
    later = spark.read.parquet(f"{folder}/flows.parquet")
    from pyspark.sql import functions as F

    old = later.where("flow_id = 1").withColumns({"captured_at": F.lit("2023-01-01").cast("timestamp_ntz"), "sinks": F.expr("array(named_struct('type', 'db', 'target', 'gone'))")})
    later.unionByName(later).unionByName(old).write.parquet(str(tmp_path / "flows.parquet"))
    assert rows(spark, str(tmp_path), "AGG-05_blast_radius") == {("db", "t", 2)}
    assert rows(spark, str(tmp_path), "SCL-21_blast") == rows(spark, folder, "SCL-21_blast")
