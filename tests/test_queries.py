"""Every registered query against its SQL on another engine, and its plan."""

import math

import duckdb
import pytest

from areaframe.queries import ORACLES, QUERIES
from areaframe.queries.registry import SCHEMAS

TRAINED = {"boosted_trees", "boosted_trees_rows", "neural_net", "neural_net_rows", "train_evaluate"}
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "array<double>": "DOUBLE[]",
}


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return connection


def canonical(listed, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        return None if isinstance(x, float) and math.isnan(x) else x

    return sorted((tuple(one(r[i]) for i in order) for r in listed), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, tiny, name):
    got = QUERIES[name](spark, tiny)
    expected = duck.sql(ORACLES[name])
    assert {c: TYPES[t] for c, t in got.dtypes} == {
        c: str(t) for c, t in zip(expected.columns, expected.types)
    }
    left = canonical([tuple(r) for r in got.collect()], got.columns)
    assert left == canonical(expected.fetchall(), expected.columns)
    assert left


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_plan_has_no_costly_steps(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert step not in plan


def test_filters_and_columns_reach_the_scan(spark, tiny):
    plan = QUERIES["filtered_sum_left_fill"](spark, tiny)._jdf.queryExecution().toString()
    assert "IsNotNull(o_custkey)" in plan
    assert "Not(EqualNullSafe(o_orderstatus,F))" in plan
    assert "struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    plan = QUERIES["drop_subset_missing"](spark, tiny)._jdf.queryExecution().toString()
    assert "IsNotNull(toxic)" in plan and "struct<doc_id:bigint>" in plan


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 150
    assert set(contract.oracle_sql()) <= set(contract.queries())
