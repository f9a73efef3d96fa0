"""Registered queries against their SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "rec_id", "ref"]
