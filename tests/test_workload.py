"""Every registered query against its SQL, at the smallest scale."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compared
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).columns == ["region", "revenue"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name, plan):
    df = QUERIES[name](spark, SF_DIR)
    got, want = compared(df, duck.execute(ORACLE[name]))
    assert got == want
    assert not re.search(r"EvalPython|InPandas|CartesianProduct|BroadcastNestedLoopJoin", plan(df))
