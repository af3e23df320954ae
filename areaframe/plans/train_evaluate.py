"""Train two classifiers on the model table and judge them on held-out areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import rows
from ..operators.features import (
    TRAIN,
    VALIDATION,
    apply_scaling,
    fit_scaling,
    stratified_split,
)
from ..operators.metrics import accuracy_of, confusion, log_loss_of, one_vs_rest_auc
from ..operators.models import Model, fit_boosted_trees, fit_relu_net, predict, training_trace
from ..operators.projection import shift
from ..session import cut_lineage
from .common import KEY

# Target and its classes, seed of the split, the column left unscaled.
TARGET = "hvi"
CLASSES = (0, 1, 2, 3, 4)
SEED = 5353456
UNSCALED = ("most_common_landuse_code",)


def feature_names(features: DataFrame, key: str = KEY, target: str = TARGET) -> list[str]:
    return [name for name in features.columns if name not in (key, target, "split")]


def prepare_features(
    features: DataFrame,
    key: str = KEY,
    target: str = TARGET,
    classes: Sequence[int] = CLASSES,
    unscaled: Sequence[str] = UNSCALED,
    seed: int = SEED,
) -> DataFrame:
    """Classes from 0, a stratified split, and columns scaled by the training part. Areas may come
    more than once: a spine with repeated keys has a row for each."""
    indexed = features.withColumn(target, shift(target, -1).cast("int"))
    parts = stratified_split(indexed, key, target, classes, seed, repeats=True)
    scaled = [name for name in feature_names(features, key, target) if name not in unscaled]
    train = parts.filter(F.col("split") == TRAIN)
    return apply_scaling(parts, fit_scaling(train, scaled), scaled)


def evaluate(
    name: str,
    model: Model,
    prepared: DataFrame,
    target: str = TARGET,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Long table of measures: overall ones without a class, AUC also per class,
    and the confusion matrix of held-out rows by class and predicted class. The
    numbers of rows behind the measures stand beside them: a net skips rows that
    miss a feature. Loss and accuracy after every training step are there as
    ``trace_loss`` and ``trace_accuracy``, with the step and the part they were taken on.

    Held-out rows are scored once and their scores written. What a part yields is
    one row per class at most, so its measures are put together in one row and then listed.
    """

    def scored(part: str) -> DataFrame:
        rows_of = prepared.filter(F.col("split") == part)
        return predict(model, rows_of, target, max(classes) + 1)

    def entry(
        metric: str, value: Column, class_: Column | None = None, predicted: Column | None = None
    ) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            (F.lit(None) if class_ is None else class_).cast("int").alias("class"),
            (F.lit(None) if predicted is None else predicted).cast("int").alias("predicted"),
            F.lit(None).cast("int").alias("step"),
            F.lit(None).cast("string").alias("part"),
            value.cast("double").alias("value"),
        )

    right = accuracy_of("label", "prediction")
    trained = scored(TRAIN).agg(
        F.array(
            entry("train_rows", rows()),
            entry("train_accuracy", right),
            entry("train_log_loss", log_loss_of("label", "scores")),
        ).alias("entries")
    )
    held_out = cut_lineage(scored(VALIDATION).select("label", "prediction", "scores"))
    overall = held_out.agg(F.array(entry("rows", rows()), entry("accuracy", right)).alias("entries"))
    matrix = confusion(held_out, "label", "prediction", classes)
    by_pair = matrix.select(
        F.array(
            *[
                entry("confusion", F.col(f"predicted_{c}"), F.col("label"), F.lit(c))
                for c in classes
            ]
        ).alias("entries")
    )
    by_class = one_vs_rest_auc(held_out, "label", "scores").agg(
        F.concat(
            F.collect_list(entry("auc", F.col("auc"), F.col("class"))),
            F.array(entry("macro_auc", F.avg("auc"))),
        ).alias("entries")
    )
    entries = trained.unionByName(overall).unionByName(by_class).unionByName(by_pair)
    measured = entries.select(F.lit(name).alias("model"), F.inline("entries"))
    return measured.unionByName(traced(name, model, prepared, target))


def traced(name: str, model: Model, prepared: DataFrame, target: str) -> DataFrame:
    """The training trace in the form of the measures."""
    trace = training_trace(model, prepared.filter(F.col("split").isin(TRAIN, VALIDATION)), target)
    rows_of = F.array(*[
        F.struct(F.lit(f"trace_{of}").alias("metric"), F.col(of).alias("value")) for of in ("loss", "accuracy")
    ])
    nothing = F.lit(None).cast("int")
    return trace.select("step", "part", F.inline(rows_of)).select(
        F.lit(name).alias("model"), "metric", nothing.alias("class"), nothing.alias("predicted"), "step", "part", "value"
    )


def train_and_evaluate(
    features: DataFrame,
    classes: Sequence[int] = CLASSES,
    rounds: int = 10,
    steps: int = 1000,
    seed: int = SEED,
) -> DataFrame:
    """Both models on one prepared table, their measures in one table. The model
    table is written once: the split alone reads it three times, the fits often."""
    prepared = cut_lineage(prepare_features(cut_lineage(features), classes=classes, seed=seed))
    names = feature_names(features)
    train = prepared.filter(F.col("split") == TRAIN)
    trees = fit_boosted_trees(train, names, TARGET, rounds=rounds, classes=len(classes))
    net = fit_relu_net(train, names, TARGET, len(classes), steps=steps, seed=seed)
    judged = [
        evaluate(name, model, prepared, classes=classes)
        for name, model in (("boosted_trees", trees), ("neural_net", net))
    ]
    return judged[0].unionByName(judged[1])
