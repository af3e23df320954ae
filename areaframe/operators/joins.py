"""Joins onto a spine of keys.

Branches reach a join aggregated to one row per key, so their real size is known
when their exchange is written, and adaptive execution turns the join into a
broadcast only below its threshold. Beyond it the branch is partitioned on the key
already and the join adds no exchange for it.

That is also why adaptive execution cannot split a hot key there: it does so only
where both sides of a join come straight from an exchange. Where the left side may
repeat keys, :func:`spread_join` splits them instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import rows, summarise


@dataclass(frozen=True)
class Branch:
    """Columns for the spine, and what to write where a key has no row or value."""

    frame: DataFrame
    fill: Mapping[str, float] = field(default_factory=dict)


def inner_spine(key: str, *parts: DataFrame) -> DataFrame:
    """The keys that all parts have."""
    return reduce(lambda left, right: left.join(right, key, "inner"), parts)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    hot_share: int = 1000,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join of a ``left`` in which few keys may hold most rows to a ``right`` with
    one row per key. The result is that of the plain join.

    A key is hot when it holds more than one part in ``hot_share`` of the left
    rows, so there are fewer hot keys than that, and so are their rows on the
    right: these are broadcast, and the hot rows of ``left`` are joined where they
    lie, whatever they look like. All other rows are joined as they are. ``counts``
    may bring ``_rows`` by key from where it is cheaper to count, as long as they are no fewer.
    """
    counts = summarise(left, key, _rows=rows()) if counts is None else counts
    limit = counts.agg(F.sum("_rows") / hot_share).scalar()
    hot = F.broadcast(counts.filter(F.col("_rows") > limit).select(key))
    beside = F.broadcast(right.join(hot, key))
    # Marked, not split by semi joins: those would be pushed below a grouping in ``left``, whose
    # exchange the two parts could then not share. Rows without a key stay with the others.
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    warm = marked.filter("_hot").drop("_hot").join(beside, key, how)
    return warm.unionByName(marked.filter("_hot IS NULL").drop("_hot").join(right, key, how))


def left_onto(
    spine: DataFrame,
    branch: DataFrame,
    key: str,
    fill: Mapping[str, float] | None = None,
    repeated: bool = False,
) -> DataFrame:
    """Left join with constants for missing values; keeps every row of the spine.
    Say ``repeated`` where the spine has many rows per key; the branch has one."""
    if repeated:
        joined = spread_join(spine, branch, key)
    else:
        joined = spine.join(branch, key, "left")
    return joined.na.fill(dict(fill)) if fill else joined


def assemble(
    spine: DataFrame, key: str, branches: Sequence[Branch], repeated: bool = False
) -> DataFrame:
    """The spine with all branches, one row per row of the spine.

    Where the spine is ``repeated``, its keys get the branches once each and the
    rows are joined to the finished table in one step.
    """
    if repeated:
        keys = spine.select(key).filter(F.col(key).isNotNull()).distinct()
        features = assemble(keys, key, [Branch(b.frame) for b in branches])
        fill = {name: value for b in branches for name, value in b.fill.items()}
        return left_onto(spine, features, key, fill, repeated=True)
    return reduce(lambda left, b: left_onto(left, b.frame, key, b.fill), branches, spine)


def lookup_counts(spine: DataFrame, df: DataFrame, key: str, name: str) -> DataFrame:
    """How often each key of the spine occurs in ``df``; 0 when it does not."""
    return left_onto(spine, summarise(df, key, **{name: rows()}), key, {name: 0})


def bridge_counts(
    items: DataFrame,
    bridge: DataFrame,
    on: str,
    target: str,
    name: str,
    distinct: bool = False,
) -> DataFrame:
    """Items per ``target`` through a many-to-many bridge ``on`` -> ``target``.

    An item counts once per matching row of the bridge, or with ``distinct`` once
    per target. The rows of the product are never made: both sides are counted
    first and the counts multiplied. A key that holds a third of the items is one
    row by then; one that holds a third of the links has a row per target, which
    the join spreads. Which keys those are is told by these rows themselves, an
    exchange that the plan has already. Items that match nothing have no target.
    """
    per_item = summarise(items, on, _items=rows())
    per_link = summarise(bridge, [on, target], _links=F.lit(1) if distinct else rows())
    # Counted over ``_links`` so that the plan of ``per_link`` is the same everywhere and read once.
    per_key = summarise(per_link, on, _rows=F.count_if(F.col("_links") > 0))
    pairs = spread_join(per_link, per_item, on, "inner", counts=per_key)
    return pairs.groupBy(target).agg(F.sum(F.col("_items") * F.col("_links")).alias(name))


def outer_align(key: str, *tables: DataFrame) -> DataFrame:
    """Grouped tables side by side, with every key that any of them has."""
    return reduce(lambda left, right: left.join(right, key, "full"), tables)
