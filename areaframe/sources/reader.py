"""CSV and Parquet sources as typed frames in which missing is NULL."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import as_column, nan_to_null, tokens_to_null
from ..operators.projection import select_positions
from .rejects import Checked, read_checked
from .schemas import SOURCES, TREE_COLUMNS, TREE_POSITIONS, SourceSpec


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column as text, quotes doubled inside quotes.

    Only the header is looked at here. Line breaks inside quotes belong to their
    field, at the price of one task per file; say ``multi_line=False`` for large
    files that are known to have none. A record with more fields than the header
    stops the job, so all columns are parsed.
    """
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .csv(path)
    )


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to their declared types. Tokens and NaN become NULL; text
    that is no number in a column declared as one stops the job."""

    def convert(field: T.StructField):
        c = as_column(field.name)
        if isinstance(field.dataType, T.StringType):
            return tokens_to_null(c.cast("string")).alias(field.name)
        if isinstance(df.schema[field.name].dataType, T.StringType):
            c = tokens_to_null(F.trim(c)).cast("double")
        if isinstance(field.dataType, T.DoubleType):
            return nan_to_null(c.cast("double")).alias(field.name)
        number = nan_to_null(c.cast("double"))
        broken = F.raise_error(F.concat(F.lit(f"{field.name} is not whole: "), number.cast("string")))
        whole = F.when(number != F.floor(number), broken).otherwise(number)
        return whole.cast(field.dataType).alias(field.name)

    return df.select(*[convert(field) for field in schema.fields])


def read_source(
    spark: SparkSession, path: str, spec: SourceSpec, form: str = "csv", multi_line: bool = True
) -> DataFrame:
    """One source under our column names and types, by header name or position."""
    raw = read_csv(spark, path, multi_line) if form == "csv" else spark.read.format(form).load(path)
    if spec.spelled:
        named = raw.select(*[as_column(there).alias(ours) for ours, there in spec.spelled.items()])
    else:
        named = raw.toDF(*spec.schema.names)
    return typed(named, spec.schema)


def read_tree_census(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Tree rows by position, for census files whose headers are not relied on."""
    raw = select_positions(read_csv(spark, path, multi_line), TREE_POSITIONS, TREE_COLUMNS)
    return typed(raw, T.StructType([T.StructField(name, T.StringType()) for name in TREE_COLUMNS]))


def read_sources(
    spark: SparkSession, folder: str, form: str = "csv", multi_line: bool | Mapping[str, bool] = True
) -> dict[str, DataFrame]:
    """All sources of the area jobs from one folder, lazily. ``multi_line`` may say for single sources whether fields hold line breaks;
    those without are read by many tasks per file."""
    broken = multi_line if isinstance(multi_line, Mapping) else dict.fromkeys(SOURCES, multi_line)
    return {
        name: read_source(spark, os.path.join(folder, spec.file), spec, form, broken.get(name, True))
        for name, spec in SOURCES.items()
    }


def read_sources_checked(
    spark: SparkSession, folder: str, multi_line: bool | Mapping[str, bool] = True
) -> dict[str, Checked]:
    """As :func:`read_sources`, from CSV, with bad records set aside instead of stopping the job."""
    broken = multi_line if isinstance(multi_line, Mapping) else dict.fromkeys(SOURCES, multi_line)
    return {
        name: read_checked(spark, os.path.join(folder, spec.file), spec, broken.get(name, True))
        for name, spec in SOURCES.items()
    }
