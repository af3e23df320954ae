"""From a feature table to model input: vectors, splits, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import as_column, nan_to_null
from .filters import drop_incomplete

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def assemble_vectors(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    invalid: str = "error",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Feature columns as one vector, the label as a double. ``invalid`` says what
    a missing feature does: 'error', 'skip' the row, or 'keep' it as NaN."""
    named = df.select(
        *[as_column(f).cast("double").alias(f) for f in features],
        as_column(label).cast("double").alias("label"),
        *[as_column(k) for k in keep],
    )
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid=invalid
    )
    return assembler.transform(named).select("features", "label", *keep)


def drop_missing_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return drop_incomplete(df, features)


# Splits


def proportional_quotas(groups: Column, share: float) -> Column:
    """``ceil(share * all)`` rows dealt to groups in proportion to their size:
    whole parts first, then one each by largest remainder, smaller label first.

    Takes an array of (label, size, full), one entry per class, and adds ``quota``
    to each; ``full`` is only handed on. Products of counts go through decimals: they pass 64 bits on large tables.
    """
    size = F.aggregate(groups, F.lit(0).cast("bigint"), lambda acc, g: acc + g["size"])
    draws = F.ceil(size * F.lit(float(share))).cast("bigint")
    wide = "decimal(19,0)"

    def portion(g: Column) -> Column:
        product = g["size"].cast(wide) * draws.cast(wide)
        rest = product % F.greatest(size, F.lit(1)).cast(wide)
        whole = ((product - rest) / F.greatest(size, F.lit(1)).cast(wide)).cast("bigint")
        return F.struct(
            (-rest).alias("order"),
            g["label"].alias("label"),
            g["size"].alias("size"),
            whole.alias("whole"),
            g["full"].alias("full"),
        )

    portions = F.array_sort(F.transform(groups, portion))
    given = F.aggregate(portions, F.lit(0).cast("bigint"), lambda acc, g: acc + g["whole"])
    return F.transform(
        portions,
        lambda g, place: F.struct(
            g["label"].alias("label"),
            g["size"].alias("size"),
            g["full"].alias("full"),
            (g["whole"] + (place < draws - given).cast("bigint")).alias("quota"),
        ),
    )


def split_cuts(
    sizes: DataFrame, test_share: float, validation_share: float
) -> DataFrame:
    """From (label, size), one row per class: after how many rows of a class, in
    hash order, its test rows end, and after how many its validation rows."""
    group = F.struct("label", "size", F.col("size").alias("full"))
    one = sizes.agg(F.collect_list(group).alias("groups"))
    tested = one.select(proportional_quotas(F.col("groups"), test_share).alias("tested"))
    rest = F.transform(
        "tested",
        lambda g: F.struct(
            g["label"].alias("label"),
            (g["size"] - g["quota"]).alias("size"),
            g["size"].alias("full"),
        ),
    )
    validated = tested.select("tested", proportional_quotas(rest, validation_share).alias("rest"))
    ends = validated.select(
        F.explode(
            F.concat(
                F.transform("tested", lambda g: F.struct(
                    g["label"].alias("_class"), F.lit(TEST).alias("_part"),
                    g["quota"].alias("_rows"))),
                F.transform("rest", lambda g: F.struct(
                    g["label"].alias("_class"), F.lit(VALIDATION).alias("_part"),
                    (g["full"] - g["size"] + g["quota"]).alias("_rows"))),
            )
        ).alias("end")
    )
    return ends.select("end.*")


ORDER_BITS = 60


def split_order(row_id: str, seed: int) -> Column:
    """The first 60 bits of the MD5 of ``seed:id``, as a number: an order by chance that does not depend on the engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(as_column(row_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def stratified_split(
    df: DataFrame,
    row_id: str,
    label: str,
    classes: Sequence,
    seed: int,
    test_share: float = 0.1,
    validation_share: float = 0.1,
    bits: int = 16,
    repeats: bool = False,
) -> DataFrame:
    """Adds ``split``: per class an exact, seeded share of test rows, then of the
    rest an exact share of validation rows.

    Rows are ordered within a class by :func:`split_order`, which any engine can
    work out, then by id. The place of each
    cut in that order is found in two narrow passes: counts per hash range say
    which range a cut falls into, and only the rows of that range are ranked.
    Every row is then compared with its class's cuts. No class is ever sorted or
    held in one task, and the rows themselves are not exchanged. The cuts are
    broadcast: at most two rows for each of the given ``classes``. A label
    outside ``classes`` stops the job, and so does an id on both sides of a cut: ids
    that repeat elsewhere share a part and leave the sizes exact. With ``repeats`` the rows of
    an id on a cut are told apart by all their columns, and equal rows by number, so that sizes stay
    exact there too. Only those rows are exchanged.
    """
    hashed = split_order(row_id, seed)
    position = F.struct(hashed.alias("hash"), as_column(row_id).alias("id"))
    # Saying that the class is present, which follows, keeps both uses of the
    # counts below alike, so that their exchange is made once.
    placed = df.select(as_column(label).alias("_class"), position.alias("_at")).filter(
        F.col("_class").isNotNull() & F.col("_class").isin(*classes)
    ).withColumn("_range", F.shiftright(F.col("_at.hash"), ORDER_BITS - bits))

    ranges = placed.groupBy("_class", "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = ranges.groupBy(F.col("_class").alias("label")).agg(F.sum("_n").alias("size"))
    cuts = split_cuts(sizes, test_share, validation_share)
    # Running counts over at most 2**bits ranges of one class.
    up_to = Window.partitionBy("_class").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = ranges.withColumn("_upto", F.sum("_n").over(up_to))
    cut_ranges = running.join(F.broadcast(cuts), "_class").filter(
        (F.col("_upto") - F.col("_n") < F.col("_rows")) & (F.col("_rows") <= F.col("_upto"))
    ).select("_class", "_range", "_part",
             (F.col("_rows") - F.col("_upto") + F.col("_n")).alias("_rank"))

    in_range = Window.partitionBy("_class", "_range", "_part").orderBy("_at")
    # Of the rows that share the last one's place in the order, how many lie before the cut.
    ends = (
        placed.join(F.broadcast(cut_ranges), ["_class", "_range"])
        .withColumns({
            "_place": F.row_number().over(in_range),
            "_next": F.lead("_at").over(in_range),
            "_copies": F.row_number().over(in_range) - F.rank().over(in_range) + 1,
        })
        .filter(F.col("_place") == F.col("_rank"))
    )
    if not repeats:
        ends = ends.withColumn("_at", F.when(
            F.col("_at").eqNullSafe(F.col("_next")),
            F.raise_error(F.concat(F.lit("an id stands on both sides of a cut: "), F.col("_at.id").cast("string"))),
        ).otherwise(F.col("_at")))

    def of_part(part: str, value: str, name: str) -> Column:
        return F.max(F.when(F.col("_part") == part, F.col(value))).alias(name)

    last_rows = ends.groupBy("_class").agg(
        of_part(TEST, "_at", "_test_end"),
        of_part(VALIDATION, "_at", "_validation_end"),
        of_part(TEST, "_copies", "_test_copies"),
        of_part(VALIDATION, "_copies", "_validation_copies"),
    )
    joined = df.withColumns({"_class": as_column(label), "_hash": hashed}).join(
        F.broadcast(last_rows), "_class", "left"
    )

    def on_end(end: str) -> Column:
        same = (F.col("_hash") == F.col(f"{end}.hash")) & as_column(row_id).eqNullSafe(F.col(f"{end}.id"))
        return F.coalesce(same, F.lit(False))

    def up_to_end(end: str) -> Column:
        same = (F.col("_hash") == F.col(f"{end}.hash")) & (as_column(row_id) <= F.col(f"{end}.id"))
        return (F.col("_hash") < F.col(f"{end}.hash")) | same

    in_test, in_validation = up_to_end("_test_end"), up_to_end("_validation_end")
    if repeats:
        on_cut = on_end("_test_end") | on_end("_validation_end")
        # Maps have no order.
        rest = [
            F.to_json(as_column(f.name)) if "map<" in f.dataType.simpleString() else as_column(f.name) for f in df.schema
        ]
        alike = Window.partitionBy("_class", "_hash", as_column(row_id)).orderBy(*rest)
        joined = joined.filter(~on_cut).withColumn("_copy", F.lit(0)).unionByName(
            joined.filter(on_cut).withColumn("_copy", F.row_number().over(alike))
        )

        def up_to_copy(end: str, copies: str, before: Column) -> Column:
            return F.when(on_end(end), F.col("_copy") <= F.col(copies)).otherwise(before)

        in_test = up_to_copy("_test_end", "_test_copies", in_test)
        in_validation = up_to_copy("_validation_end", "_validation_copies", in_validation)

    part = (
        F.when(~F.coalesce(F.col("_class").isin(*classes), F.lit(False)),
               F.raise_error(F.lit("label is missing or outside the given classes")))
        .when(in_test, TEST)
        .when(in_validation, VALIDATION)
        .otherwise(TRAIN)
    )
    return joined.withColumn("split", part).select(*[as_column(c) for c in df.columns], "split")


# Scaling


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with an array of (mean, scale) in the order of ``columns``: the
    population deviation over the values present, 1 for a constant column."""

    def statistics(name: str) -> Column:
        c = nan_to_null(as_column(name).cast("double"))
        spread = F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
        return F.struct(F.avg(c).alias("mean"), spread.alias("scale"))

    return train.agg(F.array(*[statistics(name) for name in columns]).alias("scaling"))


def apply_scaling(df: DataFrame, scaling: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / scale`` with the one row of :func:`fit_scaling`, read as a
    scalar subquery: a constant for the rows, neither a join nor a collect."""
    fitted = df.withColumn("_scaling", scaling.scalar())
    scaled = {
        name: F.try_divide(
            as_column(name).cast("double") - F.col("_scaling")[i]["mean"],
            F.col("_scaling")[i]["scale"],
        )
        for i, name in enumerate(columns)
    }
    return fitted.withColumns(scaled).drop("_scaling")
