"""Sinks. Each task writes its own part file; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, folder: str, mode: str = "error") -> None:
    """CSV with a header and without row numbers; missing is empty."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(folder)


def write_parquet(df: DataFrame, folder: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(folder)
