"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges that is not the smallest of its component among them, and
    that smallest one. Labels sink to the least across each edge, then to their label's."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for end in (left, right):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """The edges of each task as stars, ``chunk`` edges at a time, which keeps the
    components: fewer and shorter paths are left for the rounds over all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ends = stars(*[t[c].to_numpy() for c in ("a", "b")])
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t.schema.field(c).type) for x, c in zip(ends, ("a", "b"))], names=["a", "b"]
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= chunk:
                yield flush()
                held = []
        if held:
            yield flush()

    return edges.mapInArrow(task, edges.schema)


def _unsettled(edges: DataFrame) -> bool:
    """Whether any node has two smaller neighbours, or one while others hang on it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 100, chunk: int = 1 << 16) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``edges``,
    a frame of two columns that can be ordered. Nodes without an edge are left out.

    Large-star: every larger neighbour of a node is linked to the smallest of its
    neighbourhood. Small-star: every smaller neighbour and the node itself are. Each
    keeps the components; repeated, they leave one star per component. Minima are
    taken with partial sums and written before they are joined back, merged at every size so that the
    driver holds no side, so both sides of each join come straight from an exchange and a hub's rows can be split. Before each
    round a task turns the edges it reads into stars, at most ``chunk`` at a time, and
    then the stars of as many tasks as hold ``chunk`` edges are put together in one.
    """
    first, second = edges.columns[:2]
    high, low = F.greatest(first, second), F.least(first, second)
    current = save(
        edges.filter(F.col(first) != F.col(second)).select(high.alias("a"), low.alias("b")).distinct(), "edges"
    )
    for _ in range(most_rounds):
        current = save(_contracted(current, chunk), "stars")
        tasks = -(-current.count() // chunk)
        current = save(_contracted(current.coalesce(max(1, tasks)), chunk), "stars")
        both = current.union(current.select("b", "a"))
        least = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        wide = save(
            both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "edges"
        )
        least = save(wide.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = wide.join(least.hint("merge"), "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = save(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if not _unsettled(current):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
