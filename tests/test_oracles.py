"""Every query against its SQL on DuckDB: columns, types, rows."""

import pytest

import __spark_entry__ as entry_points
from connlens.catalog.oracles import all_oracles
from connlens.catalog.queries import all_queries
from oracle import duck, duck_result, spark_result

SF_DIR = "/root/testdata/sf0.01"

# DuckDB type -> Spark type, for the types that occur.
TYPES = {
    "VARCHAR": "string",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
}

# All pairs, and Python row by row: in no plan.
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [banned for banned in BANNED if banned in plan]
    described = con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    assert {c: t for c, t in df.dtypes} == {r[0]: TYPES[r[1]] for r in described}
    columns, rows = spark_result(df)
    assert rows, "an empty result proves nothing"
    assert (columns, rows) == duck_result(con, ORACLES[name])


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
