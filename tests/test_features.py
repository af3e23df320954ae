"""Splits and scaling."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areaframe.operators.features import (
    apply_scaling,
    assemble_vectors,
    fit_scaling,
    proportional_quotas,
    stratified_split,
)


def quotas(sizes, share):
    """Largest remainder by hand."""
    total = sum(sizes.values())
    draws = math.ceil(total * share)
    whole = {k: n * draws // total for k, n in sizes.items()}
    rest = sorted(sizes, key=lambda k: (-(sizes[k] * draws % total), k))
    for k in rest[: draws - sum(whole.values())]:
        whole[k] += 1
    return whole


SIZES = [
    {0: 33, 1: 7, 2: 60},
    {0: 5, 1: 5},
    {0: 1, 1: 999},
    {3: 12},
    {0: 1},
    {0: 3 * 10**14, 1: 10**14 + 7, 2: 5},
]


def test_quotas(spark):
    data = [(i, [(k, n, n) for k, n in sizes.items()]) for i, sizes in enumerate(SIZES)]
    df = spark.createDataFrame(data, "i int, g array<struct<label:int,size:long,full:long>>")
    got = df.select("i", proportional_quotas(F.col("g"), 0.1).alias("g")).collect()
    for i, groups in got:
        assert {g["label"]: g["quota"] for g in groups} == quotas(SIZES[i], 0.1)


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_split_is_exact_disjoint_and_seeded(spark, bits):
    sizes = {0: 503, 1: 77, 2: 1000, 3: 9}
    data = [(f"{k}-{i}", k, float(i)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "id string, label int, x double")
    parts = stratified_split(df, "id", "label", list(sizes), seed=11, bits=bits).cache()
    assert parts.columns == ["id", "label", "x", "split"]
    assert parts.count() == len(data) == parts.select("id").distinct().count()
    counts = {(r[0], r[1]): r[2] for r in parts.groupBy("label", "split").count().collect()}
    test = quotas(sizes, 0.1)
    validation = quotas({k: sizes[k] - test[k] for k in sizes}, 0.1)
    for k, n in sizes.items():
        assert counts.get((k, "test"), 0) == test[k]
        assert counts.get((k, "validation"), 0) == validation[k]
        assert counts.get((k, "train"), 0) == n - test[k] - validation[k]
    again = stratified_split(df.repartition(7), "id", "label", list(sizes), seed=11, bits=9)
    assert rows(again.select("id", "split")) == rows(parts.select("id", "split"))
    other = stratified_split(df, "id", "label", list(sizes), seed=12)
    assert rows(other.select("id", "split")) != rows(parts.select("id", "split"))


def test_label_outside_the_classes_stops_the_job(spark):
    for label in (9, None):
        df = spark.createDataFrame([("a", 0), ("b", label)], "id string, label int")
        with pytest.raises(Exception, match="outside the given classes"):
            stratified_split(df, "id", "label", [0, 1], seed=1).collect()


def test_scaled_training_columns_are_standard(spark):
    df = spark.range(200).selectExpr("id", "cast(id * 3 + 1 as double) x", "sqrt(id) y", "2.5 c")
    scaled = apply_scaling(df, fit_scaling(df, ["x", "y", "c"]), ["x", "y", "c"])
    got = scaled.agg(*[f(c) for c in "xyc" for f in (F.avg, F.stddev_pop)]).first()
    for i in (0, 2, 4):
        assert abs(got[i]) < 1e-12
    assert abs(got[1] - 1) < 1e-12 and abs(got[3] - 1) < 1e-12 and got[5] == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (3, None, 1)], "a int, b double, hvi int")
    skipped = assemble_vectors(df, ["a", "b"], "hvi", invalid="skip").collect()
    assert [(list(r.features), r.label) for r in skipped] == [([1.0, 2.0], 0.0)]
    assert assemble_vectors(df, ["a", "b"], "hvi", invalid="keep").count() == 2
    with pytest.raises(Exception):
        assemble_vectors(df, ["a", "b"], "hvi").collect()
