"""Row filters that say what happens to missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import as_column


def exclude_values(df: DataFrame, column: str, *values) -> DataFrame:
    """Rows whose value is none of ``values``; rows without a value stay."""
    tests = [~as_column(column).eqNullSafe(F.lit(value)) for value in values]
    return df.filter(reduce(and_, tests))


def keep_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(as_column(column) == F.lit(value))


def missing_and_equal(missing: str, column: str, value) -> Column:
    """True where ``missing`` has no value and ``column`` is ``value``; never NULL."""
    return as_column(missing).isNull() & as_column(column).eqNullSafe(F.lit(value))


def drop_missing_and_equal(df: DataFrame, missing: str, column: str, value) -> DataFrame:
    """Drop rows that contradict themselves, e.g. alive but of unknown health."""
    return df.filter(~missing_and_equal(missing, column, value))


def show_missing_and_equal(df: DataFrame, missing: str, column: str, value) -> DataFrame:
    """The rows that :func:`drop_missing_and_equal` drops."""
    return df.filter(missing_and_equal(missing, column, value))


def exclude_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose text lacks ``text``; rows without a value stay."""
    found = F.contains(as_column(column).cast("string"), F.lit(text))
    return df.filter(~F.coalesce(found, F.lit(False)))


def keep_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text has the form of a data row. Takes the place of skipping
    leading descriptor rows, since rows of a distributed table have no order."""
    return df.filter(as_column(column).rlike(pattern))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a value in every column (of ``subset``). Infinity is a value.

    One plain test per column, which a scan can take over; ``df.na.drop`` counts
    values per row in a single expression that never reaches the scan.
    """
    names = list(subset) if subset else df.columns
    tests = [as_column(name).isNotNull() for name in names]
    floating = (T.DoubleType, T.FloatType)
    tests += [~F.isnan(as_column(n)) for n in names if isinstance(df.schema[n].dataType, floating)]
    return df.filter(reduce(and_, tests))


def between(c: Column | str, low: float, high: float) -> Column:
    """``low <= c < high``."""
    c = as_column(c)
    return (c >= low) & (c < high)
