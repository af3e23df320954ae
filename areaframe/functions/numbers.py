"""Numbers and codes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_column, nan_to_null

# Decimal text as a lenient numeric parser takes it; keeps out '1,000', '1d', 'NaN'.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def parse_number(c: Column | str) -> Column:
    """Double from dirty text, NULL for what is not a number."""
    c = as_column(c)
    return F.when(c.rlike(NUMBER_TEXT), nan_to_null(F.trim(c).try_cast("double")))


def ratio(a: Column | str, b: Column | str, infinite: bool = False) -> Column:
    """``a / b``. Division by zero is missing; with ``infinite`` a non-zero value
    over zero is a signed infinity, which later row drops keep."""
    a, b = as_column(a).cast("double"), as_column(b).cast("double")
    result = F.try_divide(a, b)
    if infinite:
        unbounded = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
        result = F.when(b == 0, unbounded).otherwise(result)
    return result


def round_half_even(c: Column | str, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back: NumPy's rounding."""
    scale = float(10**digits)
    return F.rint(as_column(c) * scale) / scale


def bucketize(c: Column | str, edges: Sequence[float]) -> Column:
    """0 below the first edge, 1 from the first edge on, and so on; missing is 0."""
    c = nan_to_null(as_column(c).cast("double"))
    result = F.lit(0)
    for number, edge in enumerate(edges, start=1):
        result = F.when(c >= float(edge), number).otherwise(result)
    return result


def encode(c: Column | str, codes: Mapping, default=None) -> Column:
    """Constant lookup; keys outside ``codes`` and missing keys give ``default``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    found = F.try_element_at(table, as_column(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is mentioned: lambda
    variables are bound, columns that stand for long expressions may be written out anew."""
    return F.transform(F.array(value), use)[0]


def top_class(scores: Column | str) -> Column:
    """Position of the largest score, from 0; the first one on ties."""
    return let(as_column(scores), lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def soft_scores(scores: Column | str) -> Column:
    """Softmax over an array, shifted by its largest element so exp cannot overflow."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(powers, lambda x: x / t))

    def shifted(s: Column) -> Column:
        return let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), shares))

    return let(as_column(scores), shifted)
