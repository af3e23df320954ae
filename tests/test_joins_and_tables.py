"""Joins, bridges and grouped tables on small frames, against brute force."""

import random

from conftest import rows

from pyspark.sql import functions as F

from areaframe.operators.aggregates import (
    contingency,
    contingency_shares,
    histogram,
    majority_group,
    top_column,
    value_counts,
)
from areaframe.functions import code_from_text
from areaframe.operators.joins import bridge_counts, lookup_counts, outer_align
from areaframe.operators.projection import select_positions, set_names


def test_bridge_counts_match_the_join(spark):
    rng = random.Random(7)
    items = [(rng.choice(["a", "b", "c", "d", None]),) for _ in range(60)]
    links = [(rng.choice(["a", "b", "c", "e", None]), rng.choice(["1", "2", "3", None]))
             for _ in range(80)]
    item_df = spark.createDataFrame(items, "on string")
    link_df = spark.createDataFrame(links, "on string, zip string")
    for distinct in (False, True):
        bridge = set(links) if distinct else links
        expected = {}
        for (block,) in items:
            for other, target in bridge:
                if block is not None and block == other and target is not None:
                    expected[target] = expected.get(target, 0) + 1
        got = bridge_counts(item_df, link_df, "on", "zip", "n", distinct)
        assert dict(rows(got)) == expected


def test_lookup_counts_fill_zero(spark):
    spine = spark.createDataFrame([("a",), ("b",)], "k string")
    df = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "k string")
    assert rows(lookup_counts(spine, df, "k", "n")) == [("a", 2), ("b", 0)]


def test_outer_align_keeps_all_keys(spark):
    left = spark.createDataFrame([("a", 1)], "k string, x int")
    right = spark.createDataFrame([("b", 2)], "k string, y int")
    third = spark.createDataFrame([("a", 3), ("c", 4)], "k string, z int")
    assert rows(outer_align("k", left, right, third)) == [
        ("a", 1, None, 3), ("b", None, 2, None), ("c", None, None, 4)
    ]


USES = [("a", "01"), ("a", "02"), ("a", "02"), ("a", "04"), ("b", "05"), ("b", "04"),
        ("c", "09"), ("d", None)]


def test_contingency_and_shares(spark):
    df = spark.createDataFrame(USES, "k string, u string")
    values = ["01", "02", "04", "05", "09"]
    counts = contingency(df, "k", "u", values)
    assert rows(counts) == [("a", 1, 2, 1, 0, 0), ("b", 0, 0, 1, 1, 0), ("c", 0, 0, 0, 0, 1)]
    shares = contingency_shares(df, "k", "u", values)
    assert rows(shares)[0] == ("a", 0.25, 0.5, 0.25, 0.0, 0.0)
    tops = counts.select("k", top_column(values, values).alias("top"))
    assert rows(tops) == [("a", "02"), ("b", "04"), ("c", "09")]


def test_majority_group(spark):
    df = spark.createDataFrame(USES, "k string, u string")
    codes = {"01": 1, "02": 1, "04": 2, "05": 2}
    assert rows(majority_group(df, "k", "u", codes, "g")) == [
        ("a", 1), ("b", 2), ("c", None), ("d", None)
    ]


def test_histogram_order_and_unknown(spark):
    df = spark.createDataFrame([(2,), (1,), (7,), (2,), (None,)], "g int")
    got = histogram(df, "g", {1: "one", 2: "two"})
    assert [tuple(r) for r in got.collect()] == [(1, 1, "one"), (2, 2, "two"), (7, 1, "Unknown")]


def test_value_counts_skip_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert rows(value_counts(df, "v")) == [("a", 2)]


def test_positions_with_repeated_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x.y", "x.y", "z w")
    got = select_positions(df, [1, 2], ["second", "third"])
    assert (got.columns, rows(got)) == (["second", "third"], [(2, 3)])
    assert set_names(df, ["p", "q", "r"]).columns == ["p", "q", "r"]


def test_hot_key_keeps_results_whole(spark):
    """A third of the rows on one key, on both sides of a bridge."""
    n = 30_000
    items = spark.range(n).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('b', id % 997) end as on"
    )
    links = spark.range(n).selectExpr(
        "case when id % 3 = 1 then 'hot' else concat('b', id % 991) end as on",
        "concat('z', id % 50) as zip",
    )
    got = bridge_counts(items, links, "on", "zip", "n")
    total = got.groupBy().sum("n").first()[0]
    left = {r[0]: r[1] for r in items.groupBy("on").count().collect()}
    right = {r[0]: r[1] for r in links.groupBy("on").count().collect()}
    assert total == sum(left[k] * right[k] for k in left if k in right)


def test_bridge_counts_read_each_side_once(spark, tiny):
    orders = spark.read.parquet(f"{tiny}/orders.parquet").select(F.col("o_orderkey").alias("on"))
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet")
    links = lines.select(F.col("l_orderkey").alias("on"), F.col("l_suppkey").alias("zip"))
    got = bridge_counts(orders, links, "on", "zip", "n")
    got.collect()
    final, skipped = [], None
    for line in got._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :"))
        if skipped is None or depth <= skipped:
            skipped = depth if "== Initial Plan ==" in line else None
            final.append(line)
    scans = [line for line in final if "FileScan" in line]
    assert len(scans) == 2, "\n".join(final)


def test_codes_have_one_spelling(spark):
    spelled = ["1", "01", "1.0", " 001. ", "0", "00", "100", "1.5", "A1", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spelled)], "i int, c string")
    got = df.select("i", code_from_text("c").alias("a"), code_from_text("c", 2).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == ["1", "1", "1", "1", "0", "0", "100", "1.5", "A1", "", None]
    assert [r.b for r in got] == ["01", "01", "01", "01", "00", "00", "100", "1.5", "A1", "", None]
