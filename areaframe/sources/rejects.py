"""Reading that sets bad records aside instead of stopping.

A record is rejected when it has more fields than the header or leaves a quote open, or has text that is no number, is not whole or is out of range in a
column declared so. Rejected records keep their text and all reasons. Records with fewer fields miss the last ones, which is no reason.
Counts are observed on the rows as they are read, so they cost no pass of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import as_column, nan_to_null, tokens_to_null
from .schemas import SourceSpec

CORRUPT, SURPLUS = "_corrupt", "_surplus"
SURPLUS_REASON = "more fields than the header, or an open quote"
#: Put behind a record as one field more: where it comes out tells how many fields there are, empty ones too.
MARK = "\x01"
#: How records are spelled: quotes are doubled inside quotes; a value that cannot occur stands for NULL, so that empty stays text.
FORM = {"quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": "", "mode": "PERMISSIVE"}


@dataclass(frozen=True)
class Checked:
    """``rows`` are typed. ``rejected`` has ``reasons`` and the text of the ``record``. ``counts`` holds ``rows``, ``rejected`` and
    ``rejected_<reason>`` of everything read, once ``rows`` has been run for the first time."""

    rows: DataFrame
    rejected: DataFrame
    counts: Observation


def conversion(field: T.StructField) -> tuple[Column, Column]:
    """The value of a text column as its declared type, and why it is not one; NULL where nothing is wrong."""
    text = as_column(field.name)
    if isinstance(field.dataType, T.StringType):
        return tokens_to_null(text), F.lit(None).cast("string")
    given = tokens_to_null(F.trim(text))
    number = nan_to_null(given.try_cast("double"))
    no_number = given.isNotNull() & given.try_cast("double").isNull()
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return number, F.when(no_number, f"{field.name} is no number")
    whole = number.try_cast(field.dataType)
    why = (
        F.when(no_number, f"{field.name} is no number")
        .when(number != F.floor(number), f"{field.name} is not whole")
        .when(number.isNotNull() & whole.isNull(), f"{field.name} is out of range")
    )
    return whole, why


def reasons_of(schema: T.StructType) -> list[str]:
    """Every reason that a schema allows for, in the order in which a record lists them."""
    numbers = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    kinds = {
        f.name: ["is no number"] + ([] if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else ["is not whole", "is out of range"])
        for f in numbers
    }
    return [SURPLUS_REASON, *[f"{name} {why}" for name, own in kinds.items() for why in own]]


def checked(raw: DataFrame, schema: T.StructType, surplus: Column, record: Column, name: str) -> Checked:
    """Text columns under the names of ``schema`` as typed rows and rejected records. ``surplus``: whether a record has too many
    fields; ``record``: its text."""
    found = [conversion(f) for f in schema.fields]
    reasons = F.array_compact(F.array(F.when(surplus, SURPLUS_REASON), *[why for _, why in found]))
    marked = raw.select(
        *[value.alias(f.name) for f, (value, _) in zip(schema.fields, found)], reasons.alias("_reasons"), record.alias("_record")
    )
    counts = Observation(name)
    each = [
        F.count_if(F.array_contains("_reasons", why)).alias(f"rejected_{why}") for why in reasons_of(schema)
    ]
    watched = marked.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_reasons") > 0).alias("rejected"), *each
    )
    rows = watched.filter(F.size("_reasons") == 0).select(*schema.names)
    rejected = marked.filter(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), F.col("_record").alias("record"))
    return Checked(rows, rejected, counts)


def parse_lines(lines: DataFrame, column: str, schema: T.StructType, names: Sequence[str] | None = None, name: str = "lines") -> Checked:
    """Records that are the values of a text ``column``, one each, with fields in the order of ``names`` (those of ``schema`` where
    not given, which may leave fields out and order them anew). A NULL line is no record and is left out."""
    names = list(names or schema.names)
    present = lines.filter(as_column(column).isNotNull()).select(as_column(column).alias("_record"))
    parsed = present.select("_record", marked_fields(F.col("_record"), names).alias("_fields")).select("_record", "_fields.*")
    values = [F.nullif(as_column(n), F.lit(MARK)).alias(n) for n in names]
    fits = parsed.select("_record", (~ends_in_header([*names, SURPLUS])).alias("_long"), *values)
    return checked(fits, schema, F.col("_long"), F.col("_record"), name)


def marked_fields(record: Column, names: Sequence[str]) -> Column:
    shape = ", ".join(f"`{n}` string" for n in [*names, SURPLUS])
    return F.from_csv(F.concat(record, F.lit("," + MARK)), shape, FORM)


def ends_in_header(columns: Sequence[str | Column]) -> Column:
    """Whether the mark came out among the fields that the header has, or right behind them."""
    return F.coalesce(F.array_contains(F.array(*[as_column(c) for c in columns]), MARK), F.lit(False))


def to_lines(df: DataFrame, name: str = "record") -> DataFrame:
    """Rows as records, in the spelling that :func:`parse_lines` and the CSV sink share; missing is empty."""
    spelled = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}
    return df.select(F.to_csv(F.struct(*[as_column(c) for c in df.columns]), spelled).alias(name))


def read_checked(spark: SparkSession, path: str, spec: SourceSpec, multi_line: bool = True) -> Checked:
    """A CSV source with a header, by header name or by position, bad records set aside. ``multi_line=False`` lets many tasks read one
    file, where no field holds a line break."""
    header = spark.read.option("header", True).option("multiLine", multi_line).options(**FORM).csv(path).columns
    ours = {there: mine for mine, there in spec.spelled.items()} if spec.spelled else dict(zip(header, spec.schema.names))
    place = [ours.get(there, f"_unused{i}") for i, there in enumerate(header)]
    shape = ", ".join(f"`{n}` string" for n in [*place, CORRUPT])
    raw = (
        spark.read.schema(shape).option("header", True).option("multiLine", multi_line).options(**FORM)
        .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    )
    # Of the records that do not fit the header, those in which the mark stands beyond it are too long.
    fields = marked_fields(F.regexp_replace(F.col(CORRUPT), "[\\r\\n]+$", ""), place)
    fits = F.col(CORRUPT).isNull() | ends_in_header([fields[n] for n in [*place, SURPLUS]])
    text = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in place]), {"quote": '"', "escape": '"'}))
    return checked(raw, spec.schema, ~fits, text, path)
