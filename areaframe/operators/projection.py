"""Choosing, naming and ordering columns, and combining two of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from ..functions.missing import as_column


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns by name, in that order; names may hold spaces and dots."""
    return df.select(*[as_column(name) for name in names])


def select_positions(
    df: DataFrame, positions: Sequence[int], names: Sequence[str] | None = None
) -> DataFrame:
    """Columns by position, optionally under new names. Two columns of one name
    are told apart, since the frame is renamed before it is read."""
    slots = [f"_{i}" for i in range(len(df.columns))]
    names = names or [df.columns[i] for i in positions]
    return df.toDF(*slots).select(*[slots[i] for i in positions]).toDF(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names for all columns, by position."""
    return df.toDF(*names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def difference(a: Column | str, b: Column | str) -> Column:
    """``a - b``; missing when either is."""
    return as_column(a) - as_column(b)


def shift(c: Column | str, by: float) -> Column:
    return as_column(c) + by


def percent_to_share(c: Column | str) -> Column:
    return as_column(c) / 100.0
