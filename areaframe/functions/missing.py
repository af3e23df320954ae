"""One missing value: NULL. NaN and text tokens become NULL on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts that a pandas CSV reader takes as missing by default.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def as_column(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def tokens_to_null(c: Column | str) -> Column:
    """Text that means "missing" as NULL, other text as it is."""
    c = as_column(c)
    return F.when(~c.isin(*MISSING_TOKENS), c)


def nan_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def is_missing(c: Column | str, data_type: T.DataType | None = None) -> Column:
    """NULL test; for floating columns NaN counts as missing too."""
    c = as_column(c)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def normalise_missing(df: DataFrame) -> DataFrame:
    """Apply the one-missing-value rule to every text and floating column."""

    def clean(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType):
            return tokens_to_null(field.name).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return nan_to_null(field.name).alias(field.name)
        return as_column(field.name)

    return df.select(*[clean(field) for field in df.schema.fields])
