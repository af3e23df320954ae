"""Many sources to one row per key, with two exchanges however many sources there are.

Every source becomes rows of one stream: a key, the number of its part, values to add up and values of which
the most frequent is wanted. The stream is added up by key, part and value first, which spreads a hot key over its
values and leaves one row per task where a part has no such values; then by key. What a source has to say
about a key is worked out from these sums at the end, so nothing is joined but the spine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_column
from .filters import drop_incomplete

#: Sums are kept in these two types; others are widened to them.
WHOLE, BROKEN = "bigint", "double"


@dataclass(frozen=True)
class Part:
    """One source. ``sums``: values per row to add up, missing ones left out. ``modes``: columns whose most frequent value
    is wanted, rows counted by ``weight``. ``measures``: output columns over the names of sums and modes; a key without rows in
    the source has none. ``fill``: what to write where a measure is missing."""

    frame: DataFrame
    sums: Mapping[str, Column]
    measures: Mapping[str, Column]
    modes: Mapping[str, str] = field(default_factory=dict)
    weight: Column | None = None
    fill: Mapping[str, float] = field(default_factory=dict)


def _types(part: Part) -> dict[str, str]:
    """WHOLE or BROKEN for every sum of a part."""
    schema = part.frame.select(*[c.alias(name) for name, c in part.sums.items()]).schema
    whole = ("tinyint", "smallint", "int", "bigint")
    return {f.name: WHOLE if f.dataType.simpleString() in whole else BROKEN for f in schema}


def _value_type(parts: Sequence[Part]) -> str:
    kinds = {p.frame.select(as_column(c)).schema[0].dataType.simpleString() for p in parts for c in p.modes.values()}
    if len(kinds) > 1:
        raise ValueError(f"modes of one stream must share a type, not {sorted(kinds)}")
    return kinds.pop() if kinds else "string"


def gather(key: str, parts: Sequence[Part]) -> DataFrame:
    """One row per key that any part has, with the measures of all parts. Rows without a key are left out.

    Names of sums and modes must differ between parts. A mode ignores missing values and is the smallest of tied ones."""
    types = [_types(p) for p in parts]
    kind = _value_type(parts)
    names = [n for p in parts for n in (*p.sums, *p.modes)]
    if len(names) != len(set(names)):
        raise ValueError("sums and modes of different parts need different names")
    room = {t: max([0, *(list(own.values()).count(t) for own in types)]) for t in (WHOLE, BROKEN)}
    #: Where each sum lies among the columns that all parts share.
    slot = [
        {name: f"_{t}{[n for n, u in own.items() if u == t].index(name)}" for name, t in own.items()} for own in types
    ]
    shared = [(f"_{t}{i}", t) for t in (WHOLE, BROKEN) for i in range(room[t])]

    def stream(number: int) -> DataFrame:
        part = parts[number]
        at = {place: name for name, place in slot[number].items()}
        sums = [
            (part.sums[at[place]] if place in at else F.lit(None)).cast(t).alias(place) for place, t in shared
        ]
        weight = F.lit(1) if part.weight is None else part.weight
        rows = drop_incomplete(part.frame, [key])
        if not part.modes:
            return rows.select(
                key, F.lit(number).alias("_part"), F.lit(0).alias("_slot"), F.lit(None).cast(kind).alias("_value"),
                F.lit(0).cast("bigint").alias("_n"), *sums,
            )
        # A row per mode; the sums go with the first.
        cells = [
            F.struct(F.lit(i).alias("_slot"), as_column(c).alias("_value"), weight.cast("bigint").alias("_n"),
                     *(sums if i == 0 else [F.lit(None).cast(t).alias(place) for place, t in shared]))
            for i, c in enumerate(part.modes.values())
        ]
        return rows.select(key, F.lit(number).alias("_part"), F.inline(F.array(*cells)))

    whole = reduce(DataFrame.unionByName, [stream(i) for i in range(len(parts))])
    places = [place for place, _ in shared]
    cells = whole.groupBy(key, "_part", "_slot", "_value").agg(F.sum("_n").alias("_n"), *[F.sum(p).alias(p) for p in places])

    def own(number: int) -> list[Column]:
        here = F.col("_part") == number
        sums = [F.sum(F.when(here, F.col(place))).alias(name) for name, place in slot[number].items()]
        modes = []
        for i, name in enumerate(parts[number].modes):
            candidate = F.struct((-F.col("_n")).alias("rank"), F.col("_value").alias("value"))
            wanted = here & (F.col("_slot") == i) & F.col("_value").isNotNull()
            modes.append(F.min(F.when(wanted, candidate)).getField("value").alias(name))
        return [*sums, *modes, F.max(here).alias(f"_in{number}")]

    wide = cells.groupBy(key).agg(*[c for i in range(len(parts)) for c in own(i)])
    return wide.select(
        key,
        *[F.when(F.col(f"_in{i}"), c).alias(name) for i, p in enumerate(parts) for name, c in p.measures.items()],
    )


def assemble_parts(spine: DataFrame, key: str, parts: Sequence[Part]) -> DataFrame:
    """The spine with the measures of all parts, one row per row of the spine."""
    joined = spine.join(gather(key, parts), key, "left")
    fill = {name: value for p in parts for name, value in p.fill.items()}
    return joined.na.fill(fill) if fill else joined


def total_of(name: str) -> Column:
    """A sum that is 0 where the key has rows but no value."""
    return F.coalesce(F.col(name), F.lit(0))


def mean_of(name: str, count: str) -> Column:
    """A sum over the number of values behind it; missing without any."""
    return F.try_divide(F.col(name).cast("double"), F.nullif(F.col(count), F.lit(0)))


def present(value: Column) -> Column:
    """1 where there is a value, to be added up."""
    return value.isNotNull().cast("bigint")
