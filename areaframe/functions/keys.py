"""Area keys: text of five characters, however the source spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_column, nan_to_null

KEY_WIDTH = 5


def as_text(c: Column | str) -> Column:
    """Integral number as text; a double loses its fraction first (no '10001.0')."""
    return as_column(c).cast("bigint").cast("string")


def first_five_digits(c: Column | str) -> Column:
    """The first run of five digits, NULL when there is none."""
    return F.regexp_substr(as_column(c), F.lit(r"\d{5}"))


def strip_prefix(c: Column | str, prefix: str) -> Column:
    return F.replace(as_column(c), F.lit(prefix), F.lit(""))


def zero_fill(c: Column | str, width: int = KEY_WIDTH) -> Column:
    """Zeros on the left up to ``width``; longer text is never cut."""
    c = as_column(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def key_from_number(c: Column | str, width: int = KEY_WIDTH) -> Column:
    """Key from a floating code: 501.0 becomes '00501'; missing stays missing."""
    return zero_fill(as_text(nan_to_null(as_column(c).cast("double"))), width)


def key_from_text(c: Column | str, width: int = KEY_WIDTH) -> Column:
    """Key from text. Whole numbers, also spelled '501.0', are padded; other
    text (several keys in one field, say) is kept and simply never matches.

    The cases are ordered so that a key already in form costs one test.
    """
    c = as_column(c)
    digits = F.regexp_extract(c, r"\d+", 0)
    return (
        F.when(c.rlike(rf"^\d{{{width},}}$"), c)
        .when(c.rlike(rf"^\s*\d{{1,{width - 1}}}(\.0*)?\s*$"), F.lpad(digits, width, "0"))
        .when(c.rlike(r"^\s*\d+(\.0*)?\s*$"), digits)
        .otherwise(c)
    )


def code_from_text(c: Column | str, width: int = 1) -> Column:
    """One spelling of a whole-number code: '1', '01' and '1.0' become '1', or '01'
    at a ``width`` of two. Text that is no whole number is kept."""
    c = as_column(c)
    digits = F.regexp_extract(c, r"^\s*0*(\d+?)(\.0*)?\s*$", 1)
    return F.when(c.rlike(r"^\s*\d+(\.0*)?\s*$"), zero_fill(digits, width)).otherwise(c)
