"""Parts gathered by key: equal to tables joined one by one, with few exchanges and one read of each source."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areaframe.operators.aggregates import mean, summarise, summarise_with_modes, total
from areaframe.operators.gather import Part, assemble_parts, gather, mean_of, present, total_of
from areaframe.operators.joins import Branch, assemble
from areaframe.plans import area_features, common, model_features
from areaframe.queries.area_sources import derived_sources


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    keys = ["a", "b", "c", "d", None, "hot", "hot", "hot"]
    left = [(rng.choice(keys), rng.choice([None, 1.5, 2.0, -4.0]), rng.choice([None, 1, 2])) for _ in range(300)]
    right = [(rng.choice(keys[:3]), rng.choice(["x", "y", "z", None]), rng.choice(["p", "q"]), rng.choice([1, 2, None])) for _ in range(300)]
    return (
        spark.createDataFrame([(k,) for k in ("a", "b", "b", "e", None, "hot")], "k string"),
        spark.createDataFrame(left, "k string, x double, n int").repartition(5),
        spark.createDataFrame(right, "k string, v string, w string, m bigint").repartition(3),
    )


def parts_of(left, right):
    return [
        Part(
            left, sums={"x": F.col("x"), "x_n": present(F.col("x")), "n": F.col("n"), "rows": F.lit(1)},
            measures={"total_x": total_of("x"), "mean_x": mean_of("x", "x_n"), "total_n": total_of("n"), "many": F.col("rows")},
            fill={"many": 0},
        ),
        Part(
            right, sums={"m": F.col("m")}, modes={"v_mode": "v", "w_mode": "w"},
            measures={"m": total_of("m"), "v": F.col("v_mode"), "w": F.col("w_mode")},
        ),
    ]


def test_equals_tables_joined_one_by_one(tables):
    spine, left, right = tables
    got = assemble_parts(spine, "k", parts_of(left, right))
    expected = assemble(spine, "k", [
        Branch(summarise(left, "k", total_x=total("x"), mean_x=mean("x"), total_n=total("n"), many=F.count(F.lit(1))), {"many": 0}),
        Branch(summarise_with_modes(right, "k", {"v": "v", "w": "w"}, {"m": F.col("m")}).select("k", "m", "v", "w")),
    ])
    assert got.columns == expected.columns
    assert rows(got) == rows(expected) and got.count() == 6
    # Order of parts and of rows does not matter.
    turned = assemble_parts(spine, "k", parts_of(left, right)[::-1]).select(*got.columns)
    assert rows(turned) == rows(got)


def test_weights_and_no_rows(spark, tables):
    _, left, right = tables
    cells = right.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    weighted = gather("k", [Part(cells, sums={}, modes={"mode": "v"}, weight=F.col("n"), measures={"v": F.col("mode")})])
    assert rows(weighted) == rows(summarise_with_modes(right, "k", {"v": "v"}))
    assert gather("k", parts_of(left.limit(0), right.limit(0))).collect() == []
    half = rows(gather("k", parts_of(left.limit(0), right)).select("k", "many", "m"))
    assert {r[1] for r in half} == {None} and len(half) == 3


def test_names_and_types_are_checked(tables):
    _, left, right = tables
    part = Part(left, sums={"x": F.col("x")}, measures={})
    with pytest.raises(ValueError, match="different names"):
        gather("k", [part, part])
    with pytest.raises(ValueError, match="share a type"):
        gather("k", [Part(left, sums={}, modes={"a": "n"}, measures={}), Part(right, sums={}, modes={"b": "v"}, measures={})])


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("job, most", [(area_features, 8), (model_features, 8)])
def test_sources_are_read_once_and_exchanges_are_few(spark, tiny, job, most):
    plan = final_plan(job(derived_sources(spark, tiny), 1998))
    # Of the sources derived from lineitem only lots have a part and a supplier.
    assert plan.count("struct<l_partkey:bigint,l_suppkey") == 1
    assert plan.count("Exchange hashpartitioning") <= most, plan.count("Exchange hashpartitioning")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("job", [area_features, model_features])
def test_cells_of_lots_are_added_up_in_parts_that_follow_from_the_lots(spark, tiny, monkeypatch, job):
    sources = derived_sources(spark, tiny)
    expected = rows(job(sources, 1998))
    monkeypatch.setattr(common, "LOTS_PER_TASK", 500)
    parts = -(-sources["parcels"].count() // 500)
    got = job(sources, 1998)
    assert f", {parts}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == expected
