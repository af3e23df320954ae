"""Hot keys: results stay whole and the work is split."""

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import ROOT, rows
from pyspark.sql import functions as F

from areaframe.operators.aggregates import rows as row_count
from areaframe.operators.aggregates import summarise, summarise_with_modes, total
from areaframe.operators.joins import Branch, assemble, left_onto, spread_join
from areaframe.session import cut_lineage, shared_folder


@pytest.fixture
def settings(spark):
    """Change settings for one test."""
    before = {}

    def change(name, value):
        before[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def hot(spark, n):
    return spark.range(n).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('k', id % 5000) end as k",
        "id % 1000 as x",
        "concat('v', id % 1009) as v",
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def no_broadcasts(settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def test_adaptive_execution_splits_a_join_of_two_sources(spark, settings):
    no_broadcasts(settings)
    settings("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50kb")
    settings("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "50kb")
    settings("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    settings("spark.sql.shuffle.partitions", "16")
    right = spark.range(6000).selectExpr("concat('k', id) as k", "id as y").union(
        spark.createDataFrame([("hot", 1)], "k string, y long")
    )
    joined = hot(spark, 400_000).join(right, "k", "left")
    assert "skew=true" in final_plan(joined)


def test_spread_join_is_the_plain_join(spark, settings):
    no_broadcasts(settings)
    df = hot(spark, 30_000).union(spark.createDataFrame([(None, 1, "v")], "k string, x long, v string"))
    right = summarise(df.filter("k <> 'k1'"), "k", n=row_count(), s=total("x"))
    for how in ("left", "inner"):
        plain = df.join(right, "k", how)
        for share in (1000, 5, 2):
            spread = spread_join(df, right, "k", how, share)
            assert spread.columns == plain.columns
            assert rows(spread) == rows(plain)


def test_hot_spine_key_is_spread(spark, settings):
    """Equal rows of a hot key are joined in as many tasks as hold them."""
    no_broadcasts(settings)
    settings("spark.sql.shuffle.partitions", "32")
    settings("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = hot(spark, 60_000).withColumns({"x": F.lit(1), "v": F.lit("a")}).repartition(32)
    joined = left_onto(df, summarise(df, "k", n=row_count()), "k", repeated=True)
    tasks = joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 16 and sum(t[1] for t in tasks) == 20_000


def test_assembly_onto_repeated_keys(spark):
    df = hot(spark, 5_000).drop("v")
    branches = [
        Branch(summarise(df.filter("x < 500"), "k", n=row_count()), {"n": 0}),
        Branch(summarise(df, "k", s=total("x"))),
    ]
    assert rows(assemble(df, "k", branches, repeated=True)) == rows(assemble(df, "k", branches))


def test_modes_and_sums_of_a_hot_key(spark):
    df = hot(spark, 100_000)
    got = {r[0]: tuple(r[1:]) for r in rows(
        summarise_with_modes(df, "k", {"m": "v"}, {"s": F.col("x")})
    )}
    plain = df.groupBy("k").agg(F.mode("v", True), F.sum("x"))
    assert got == {r[0]: tuple(r[1:]) for r in plain.collect()}


def test_partial_sums_come_before_the_exchange(spark):
    plan = summarise(hot(spark, 1000), "k", s=total("x"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.index("Exchange hashpartitioning(k") < physical.index("partial_sum(x")
    assert physical.count("Exchange") == 1


def test_cut_tables_lie_in_the_shared_folder(spark, tmp_path):
    if shared_folder(spark) is None:
        kept = cut_lineage(hot(spark, 100))
        assert kept.storageLevel.useDisk and rows(kept) == rows(hot(spark, 100))
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    folder = Path(shared_folder(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    before = set(folder.glob("table-*"))
    table = cut_lineage(hot(spark, 100))
    assert table.count() == 100 and len(set(folder.glob("table-*")) - before) == 1
    plan = table.select("x")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<x:bigint>" in plan and "Range" not in plan


def test_the_folder_the_cluster_names_is_used(tmp_path):
    script = (
        "from areaframe.session import get_session, shared_folder\n"
        f"spark = get_session(master='local[1]', spark__checkpoint__dir='{tmp_path}',"
        " spark__ui__enabled='false')\n"
        "print('FOLDER', shared_folder(spark), spark.conf.get('spark.sql.shuffle.partitions'))"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, text=True,
                          timeout=120)
    assert f"FOLDER {tmp_path} 8" in done.stdout
