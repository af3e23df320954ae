"""Evaluation against brute force."""

import math
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from areaframe.functions import soft_scores, top_class
from areaframe.operators.metrics import (
    accuracy,
    area_under_curve,
    confusion,
    log_loss,
    macro_auc,
    one_vs_rest_auc,
)


def brute_force(pairs):
    positives = [s for own, s in pairs if own]
    negatives = [s for own, s in pairs if not own]
    if not positives or not negatives:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    return wins / (len(positives) * len(negatives))


def auc(spark, pairs):
    df = spark.createDataFrame(pairs, "own boolean, score double").withColumn("g", F.lit(1))
    return area_under_curve(df, ["g"], F.col("own"), F.col("score")).first()["auc"]


@pytest.mark.parametrize("kind", ["ties", "spread", "crowded", "tiny", "huge", "extremes"])
def test_auc_matches_all_pairs(spark, kind):
    rng = random.Random(kind)
    make = {
        "ties": lambda: float(rng.randint(-3, 3)),
        "spread": lambda: rng.uniform(-1, 1),
        "crowded": lambda: 0.5 + rng.randint(-40, 40) * 2.0**-52,
        "tiny": lambda: math.exp(-rng.uniform(0, 700)),
        "huge": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300),
        "extremes": lambda: rng.choice(
            [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 2.0**-1010]
        ),
    }[kind]
    pairs = [(rng.random() < 0.4, make()) for _ in range(300)]
    assert auc(spark, pairs) == pytest.approx(brute_force(pairs), abs=1e-12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.floats(allow_nan=False)), min_size=2, max_size=40))
def test_auc_on_any_scores(spark, pairs):
    expected = brute_force(pairs)
    got = auc(spark, pairs)
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-12)


def test_auc_of_negated_scores(spark):
    rng = random.Random(1)
    pairs = [(rng.random() < 0.5, rng.choice([0.1, 0.2, rng.random()])) for _ in range(200)]
    assert auc(spark, pairs) + auc(spark, [(o, -s) for o, s in pairs]) == pytest.approx(1.0)


def test_one_vs_rest_and_macro(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 2), [round(rng.random(), 2) for _ in range(4)]) for _ in range(150)]
    df = spark.createDataFrame(data, "label int, scores array<double>")
    by_class = one_vs_rest_auc(df, "label", "scores")
    expected = {c: brute_force([(y == c, s[c]) for y, s in data]) for c in range(4)}
    got = {r["class"]: r["auc"] for r in by_class.collect()}
    assert got[3] is None and expected[3] is None
    assert [got[c] for c in range(3)] == pytest.approx([expected[c] for c in range(3)])
    macro = macro_auc(by_class).first()["macro_auc"]
    assert macro == pytest.approx(sum(expected[c] for c in range(3)) / 3)


def test_missing_score_stops_the_job(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(0, [0.1, bad])], "label int, scores array<double>")
        with pytest.raises(Exception, match="score is missing"):
            one_vs_rest_auc(df, "label", "scores").collect()


def test_accuracy_and_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    assert rows(accuracy(df, "y", "p")) == [(0.5,)]
    assert rows(confusion(df, "y", "p", [0, 1, 2])) == [
        (0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 1, 0)
    ]


def test_softmax_top_class_and_loss(spark):
    df = spark.createDataFrame([(1, [1000.0, 1001.0]), (0, [2.0, 2.0])], "y int, s array<double>")
    got = df.select("y", top_class("s").alias("top"), soft_scores("s").alias("s"))
    first, second = got.orderBy(F.desc("y")).collect()
    assert first["top"] == 1 and second["top"] == 0
    assert first["s"] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert second["s"] == [0.5, 0.5]
    loss = log_loss(got, "y", "s").first()["log_loss"]
    assert loss == pytest.approx((-math.log(math.e / (1 + math.e)) - math.log(0.5)) / 2)
