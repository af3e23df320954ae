"""Evaluation of class predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import as_column
from .aggregates import count_of


def accuracy_of(label: str, prediction: str) -> Column:
    """The share of rows whose prediction is the label."""
    right = as_column(label) == as_column(prediction)
    return F.try_divide(F.count_if(right), F.count(F.lit(1)))


def accuracy(df: DataFrame, label: str, prediction: str, name: str = "accuracy") -> DataFrame:
    return df.agg(accuracy_of(label, prediction).alias(name))


def confusion(
    df: DataFrame,
    label: str,
    prediction: str,
    classes: Sequence[int],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per label with a count for each predicted class."""
    names = names or [f"predicted_{c}" for c in classes]
    return df.groupBy(as_column(label).alias("label")).agg(
        *[count_of(prediction, c).alias(name) for c, name in zip(classes, names)]
    )


def log_loss_of(label: str, scores: str) -> Column:
    """The mean negative log of the score given to the true class."""
    own = F.element_at(as_column(scores), as_column(label).cast("int") + 1)
    return F.avg(-F.ln(F.greatest(own, F.lit(1e-15))))


def log_loss(df: DataFrame, label: str, scores: str, name: str = "log_loss") -> DataFrame:
    return df.agg(log_loss_of(label, scores).alias(name))


def present(c: Column, what: str) -> Column:
    missing = c.isNull() | F.isnan(c)
    return F.when(missing, F.raise_error(F.lit(f"{what} is missing"))).otherwise(c)


def area_under_curve(df: DataFrame, keys: Sequence[str], positive: Column, score: Column) -> DataFrame:
    """Per key the chance that a positive outranks a negative, ties counting half.

    Rows are counted per distinct score first. Counts of negatives below a score
    are then summed digit by digit, as in a radix sort: within scores that share
    the power of two and 30 bits after it, then between groups that share 8 bits,
    then between those. A window so never holds more than about 2**22 rows however
    many distinct scores a class has and wherever they crowd, and every exchange
    carries counts only. Powers of two scale exactly, so the digits nest exactly.
    """
    value = present(score.cast("double"), "score")
    counted = (
        df.select(*keys, positive.alias("_positive"), value.alias("_score"))
        .groupBy(*keys, "_score")
        .agg(F.count_if("_positive").cast("double").alias("_pos"),
             F.count_if(~F.col("_positive")).cast("double").alias("_neg"))
    )
    size = F.abs("_score")
    power = F.greatest(F.lit(-1000), F.least(F.lit(1023), F.floor(F.log2(size)))).cast("int")
    power = F.when(size > 0, power).otherwise(0)
    fraction = F.col("_score") * F.pow(F.lit(2.0), -F.col("_power"))
    cells = counted.withColumn("_power", power).withColumns({
        "_octave": F.signum("_score") * (F.col("_power") + 2000),
        "_coarse": F.floor(fraction * float(2**8)),
        "_fine": F.floor(fraction * float(2**30)),
        "_wins": F.col("_pos") * F.col("_neg") / 2.0,
    })
    for order, shared in (
        (["_score"], ["_octave", "_coarse", "_fine"]),
        (["_fine"], ["_octave", "_coarse"]),
        (["_octave", "_coarse"], []),
    ):
        group = [*keys, *shared]
        below = Window.partitionBy(*group).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1
        )
        lower = F.coalesce(F.sum("_neg").over(below), F.lit(0.0))
        cells = (
            cells.withColumn("_wins", F.col("_wins") + F.col("_pos") * lower)
            .groupBy(*group)
            .agg(*[F.sum(c).alias(c) for c in ("_wins", "_pos", "_neg")])
        )
    return cells.select(
        *keys, F.try_divide(F.col("_wins"), F.col("_pos") * F.col("_neg")).alias("auc")
    )


def one_vs_rest_auc(df: DataFrame, label: str, scores: str) -> DataFrame:
    """Area under the curve for each class against the others, from an array of
    scores by class; missing for a class that has no rows of its own or no others."""
    long = df.select(
        as_column(label).cast("int").alias("_label"),
        F.posexplode(as_column(scores)).alias("class", "_value"),
    )
    own = present(F.col("_label"), "label") == F.col("class")
    return area_under_curve(long, ["class"], own, F.col("_value"))


def macro_auc(by_class: DataFrame, name: str = "macro_auc") -> DataFrame:
    """One row: the plain mean over classes."""
    return by_class.agg(F.avg("auc").alias(name))
