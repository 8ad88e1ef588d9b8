"""Every registered query against its SQL, on the smallest driver tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from check import register, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    register(connection, SF_DIR)
    return connection


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
    got = df.toPandas()
    assert rows_of(got) == rows_of(db.execute(contract.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
