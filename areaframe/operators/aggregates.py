"""Measures and grouped tables.

Measures are plain aggregate columns, so that everything a source has to say
about one key goes into a single :func:`summarise`: one scan, one exchange, and
partial sums before it, which is what keeps a hot key from mattering.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_column, is_missing
from ..functions.numbers import encode, ratio
from .filters import drop_incomplete

Keys = str | Sequence[str]


def key_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# Measures


def total(c: Column | str) -> Column:
    """Sum that is 0, not missing, when the group holds no value."""
    return F.coalesce(F.sum(as_column(c)), F.lit(0))


def mean(c: Column | str) -> Column:
    return F.avg(as_column(c))


def mean_gap(a: Column | str, b: Column | str) -> Column:
    """Mean of ``a - b`` over the rows that have both."""
    return F.avg(as_column(a) - as_column(b))


def rows() -> Column:
    return F.count(F.lit(1))


def total_per_row(c: Column | str) -> Column:
    """Sum over the number of rows, rows without a value included."""
    return ratio(total(c), rows())


def total_over_total(a: Column | str, b: Column | str, infinite: bool = False) -> Column:
    return ratio(total(a), total(b), infinite)


def count_of(c: Column | str, value) -> Column:
    return F.count_if(as_column(c) == F.lit(value))


def share_of(c: Column | str, value) -> Column:
    """Part of the rows with a value in which that value is ``value``."""
    return ratio(count_of(c, value), F.count(as_column(c)))


# Grouped tables


def summarise(df: DataFrame, keys: Keys, **measures: Column) -> DataFrame:
    """One row per key with the given measures; rows without a key are left out."""
    keys = key_list(keys)
    named = [measure.alias(name) for name, measure in measures.items()]
    return drop_incomplete(df, keys).groupBy(*keys).agg(*named)


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    return summarise(df, column, **{name: rows()})


def summarise_with_modes(
    df: DataFrame,
    keys: Keys,
    modes: Mapping[str, str],
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Most frequent value per key for each of ``modes`` (output to column), the
    smallest one on ties, next to sums of row-level ``totals``, from one scan.

    A mode is not kept as a map per group, whose size nobody bounds. Rows are
    first counted per key and value, which spreads a hot key over its values;
    the winner is then picked from the counts. Several modes share the first
    count: their values are stacked after it, when the table is small already.
    """
    keys, totals = key_list(keys), dict(totals or {})
    slots = [f"_value{i}" for i in range(len(modes))]
    sums = [f"_total{i}" for i in range(len(totals))]
    keyed = drop_incomplete(df, keys).select(
        *keys,
        *[as_column(c).alias(slot) for c, slot in zip(modes.values(), slots)],
        *[c.alias(slot) for c, slot in zip(totals.values(), sums)],
    )
    cells = keyed.groupBy(*keys, *slots).agg(rows().alias("_n"), *[total(s).alias(s) for s in sums])
    if len(slots) > 1:
        kept = [F.col(s) for s in sums]
        empty = [F.lit(0).cast(cells.schema[s].dataType).alias(s) for s in sums]
        stacked = [
            F.struct(
                *[(F.col(s) if s == slot else F.lit(None).cast(cells.schema[s].dataType)).alias(s)
                  for s in slots],
                F.lit(number).alias("_slot"),
                *(kept if number == 0 else empty),
            )
            for number, slot in enumerate(slots)
        ]
        cells = (
            cells.select(*keys, "_n", F.explode(F.array(*stacked)).alias("_cell"))
            .select(*keys, "_n", "_cell.*")
            .groupBy(*keys, "_slot", *slots)
            .agg(F.sum("_n").alias("_n"), *[F.sum(s).alias(s) for s in sums])
        )

    def winner(slot: str) -> Column:
        candidate = F.struct((-F.col("_n")).alias("rank"), F.col(slot).alias("value"))
        return F.min(F.when(F.col(slot).isNotNull(), candidate)).getField("value")

    return cells.groupBy(*keys).agg(
        *[winner(slot).alias(name) for name, slot in zip(modes, slots)],
        *[F.sum(s).alias(name) for name, s in zip(totals, sums)],
    )


def mode_by_key(df: DataFrame, keys: Keys, column: str, name: str) -> DataFrame:
    return summarise_with_modes(df, keys, {name: column})


def contingency(
    df: DataFrame, keys: Keys, column: str, values: Sequence, names: Sequence[str] | None = None
) -> DataFrame:
    """Counts of each of ``values`` side by side. With the values given, a count
    per value in one pass needs one exchange, where a pivot needs two."""
    names = names or [str(value) for value in values]
    counts = {name: count_of(column, value) for name, value in zip(names, values)}
    return summarise(drop_incomplete(df, [column]), keys, **counts)


def contingency_shares(
    df: DataFrame, keys: Keys, column: str, values: Sequence, names: Sequence[str] | None = None
) -> DataFrame:
    """As :func:`contingency`, each count over the number of rows with a value."""
    names = names or [str(value) for value in values]
    shares = {name: share_of(column, value) for name, value in zip(names, values)}
    return summarise(drop_incomplete(df, [column]), keys, **shares)


def top_column(values: Sequence, names: Sequence[str]) -> Column:
    """Of columns ``names``, the entry of ``values`` for the largest; first on ties."""
    counts = F.array(*[as_column(name) for name in names])
    position = F.array_position(counts, F.array_max(counts)).cast("int")
    return F.element_at(F.array(*[F.lit(value) for value in values]), position)


def majority_group(
    df: DataFrame, keys: Keys, column: str, codes: Mapping, name: str
) -> DataFrame:
    """The most frequent value per key as its group code; NULL when it has none."""
    return mode_by_key(df, keys, column, name).withColumn(name, encode(name, codes))


def histogram(
    df: DataFrame, column: str, labels: Mapping, label: str = "label", name: str = "count"
) -> DataFrame:
    """Counts per value in order of the values, with labels, 'Unknown' without one."""
    counts = value_counts(df, column, name)
    return counts.withColumn(label, encode(column, labels, "Unknown")).orderBy(column)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: in how many rows each column has no value."""
    columns = columns or df.columns
    return df.agg(
        *[F.count_if(is_missing(c, df.schema[c].dataType)).alias(c) for c in columns]
    )
