"""Classifiers: fitting, scoring, and their traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_column
from ..functions.numbers import soft_scores, top_class
from .boosting import BoostedTrees, Penalty, fit_boosted_trees
from .nets import ReluNet, fit_relu_net

__all__ = ["BoostedTrees", "Penalty", "ReluNet", "fit_boosted_trees", "fit_relu_net", "predict", "training_trace"]

Model = BoostedTrees | ReluNet


def predict(model: Model, df: DataFrame, label: str, classes: int | None = None) -> DataFrame:
    """Adds ``label``, ``prediction`` and ``scores``, an array with one per class that sums to 1.

    Trees score every row. A net skips rows that miss a feature. A model knows the classes up to the largest of its
    training rows; of ``classes`` in all, the others score 0.
    """
    if isinstance(model, ReluNet):
        df = model.complete(df)
    scored = df.withColumn("label", as_column(label).cast("int")).withColumn("scores", soft_scores(model.margins()))
    scored = scored.withColumn("prediction", top_class("scores"))
    if classes is not None:
        absent = F.greatest(F.lit(classes) - F.size("scores"), F.lit(0))
        scored = scored.withColumn("scores", F.concat("scores", F.array_repeat(F.lit(0.0), absent)))
    return scored


def training_trace(model: Model, parts: DataFrame, label: str, part: str = "split") -> DataFrame:
    """(part, step, rows, loss, accuracy) after each step, 0 before the first. Trees are judged on every part of ``parts``, all
    rounds in one pass; a net kept what its steps met on their way, on its training rows, which are named as in ``part``."""
    if isinstance(model, BoostedTrees):
        return model.staged(parts, label, part).withColumnRenamed(part, "part").select("part", "step", "rows", "loss", "accuracy")
    rows = [("train", i, *at) for i, at in enumerate(model.trace)]
    return parts.sparkSession.createDataFrame(rows, "part string, step int, rows bigint, loss double, accuracy double")
