"""Mixing sources to target weights by balanced sampling (cube method).

A source's target is met by taking each of its documents ``floor(target / size)`` times and a
balanced sample of them once more. The sample's inclusion probabilities walk through the
null space of two constraints, the source's words and its documents, until every one is
0 or 1. Blocks of documents walk at the same time; each leaves at most two undecided,
which meet in fewer blocks on the next level, down to one landing per source. A few hundred documents of a large source wait
for that last level: the two left over may be large, and what settling them costs is made up by turning the choice of smaller ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import extend, extended, pieces, runs, save
from .words import word_spans


def with_sizes(docs: DataFrame, text_col: str = "text", name: str = "size") -> DataFrame:
    """``docs`` with the number of words of each text; null has none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, text_col):
            yield extend(rows, {name: pa.array(np.diff(word_spans(data, marks)[2]))})

    return docs.mapInArrow(task, extended(docs, {name: "bigint"}))


def source_targets(
    units: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Per source: ``source_size``, ``target`` and ``n_units``.

    Sources in order of code points, null last, take the weights in turn. ``share`` of all
    words is dealt by weight; what passes ``most`` times a source's size is dealt again to the
    others. The level every uncapped source reaches per unit of weight is the largest of
    (rest of the words) / (rest of the weight) over how many are capped, in order of cap per weight.
    """
    sums = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_units")
    )
    listed = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(by_cap), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("_w").over(by_cap), F.lit(0.0))
    )
    return (
        sums.withColumn("_w", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every) * float(share))
        .withColumn("_weights", F.sum("_w").over(every))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(every))
        .select(
            "source", "source_size", "n_units",
            F.least(F.col("_w") * F.col("_level"), F.col("_cap")).alias("target"),
        )
    )


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities until no three are strictly between 0 and 1, keeping their sum and
    the sum of ``size`` times them; each keeps its mean over the draws."""
    p, size = p.tolist(), size.tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    active: list[int] = []
    coming = iter(range(len(p)))
    tiny = 1e-9
    while True:
        while len(active) < 3:
            nxt = next(coming, None)
            if nxt is None:
                break
            active.append(nxt)
        if len(active) < 3:
            if len(active) < 2 or size[active[0]] != size[active[1]]:
                break
            i, j = active
            step = [(i, 1.0), (j, -1.0)]
        else:
            i, j, k = active
            u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            step = list(zip(active, u))
        up = min((1 - p[a]) / v if v > 0 else -p[a] / v for a, v in step if v)
        down = min(p[a] / v if v > 0 else (p[a] - 1) / v for a, v in step if v)
        move = up if next(draws, 0.5) * (up + down) < down else -down
        for a, v in step:
            p[a] += move * v
            if p[a] < tiny:
                p[a] = 0.0
            elif p[a] > 1 - tiny:
                p[a] = 1.0
        active = [a for a in active if 0 < p[a] < 1]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The last few (two at most after a flight): of all outcomes the one whose words are
    nearest what is due, then whose documents are. Then, from large to small, a choice is turned wherever that brings the words
    nearer to those of ``start``, the probabilities before the flight."""
    open_at = np.flatnonzero((p > 0) & (p < 1))
    if len(open_at):
        outcomes = [np.array(list(np.binary_repr(i, len(open_at))), float) for i in range(2 ** len(open_at))]
        due, own = p[open_at], size[open_at]
        p[open_at] = min(outcomes, key=lambda o: (abs(((o - due) * own).sum()), abs((o - due).sum())))
    miss = float(((p - start) * size).sum())
    for i in np.lexsort((start, -size)).tolist():
        change = float(size[i]) * (1 - 2 * p[i])
        if abs(miss + change) < abs(miss) - 1e-6:
            p[i], miss = 1 - p[i], miss + change
    return p


def _level(block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit"):
            units = table["unit"].to_numpy()
            cuts = np.flatnonzero(units[1:] != units[:-1]) + 1
            p, size = table["p"].to_numpy().copy(), table["weight"].to_numpy()
            last = table["blocks"].to_numpy() == 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)]):
                rng, start = np.random.default_rng(int(units[s]) & (2**63 - 1)), p[s:e].copy()
                p[s:e] = fly(p[s:e], size[s:e], rng)
                if last[s]:
                    p[s:e] = land(p[s:e], size[s:e], start)
            out = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))
            yield from out.select(["key", "source", "weight", "p", "late"]).to_batches()

    return task


def balanced_sample(units: DataFrame, block: int = 2048, waiting: int = 256) -> DataFrame:
    """(key, chosen 0 or 1) for rows (key, source, weight, p), balanced on weight and count within
    each source. Blocks are dealt by a hash of the key, so a large source is many of them. About ``waiting`` documents of a source
    of more than one block wait for its last level."""
    open_units = units.filter("p > 0 AND p < 1")
    many = save(open_units.groupBy(F.col("source").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / waiting).alias("_share"), (F.count(F.lit(1)) > block).alias("_many")), "shares")
    late = F.col("_many") & (F.pmod(F.xxhash64("key", F.lit(37)), F.col("_share")) == 0)
    held = save(
        open_units.join(many, F.col("source").eqNullSafe(F.col("_s"))).select("key", "source", "weight", "p", late.alias("late")), "open"
    )
    done = None
    for _ in range(40):
        open_rows = held.filter("p > 0 AND p < 1")
        blocks = F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("late")) / block)).cast("int")
        counts = save(open_rows.groupBy("source").agg(blocks.alias("blocks")), "counts")
        if counts.isEmpty():
            break
        # One row per source on the right, few beside the units: sources are not documents.
        dealt = open_rows.join(
            counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        )
        wait = dealt.filter("late AND blocks > 1").select("key", "source", "weight", "p", "late")
        walk = dealt.filter("NOT (late AND blocks > 1)").withColumn(
            "unit", F.xxhash64("source", F.pmod(F.xxhash64("key", F.lit(29)), F.col("blocks")))
        )
        flown = (
            walk.select("unit", "key", "source", "weight", "p", "blocks", "late")
            # Large documents go first, among their like: what lands is more often small.
            .repartition("unit").sortWithinPartitions("unit", F.desc("weight"), F.xxhash64("key", F.lit(31)), "key")
            .mapInArrow(_level(block), f"key bigint, source {units.schema['source'].dataType.simpleString()}, weight bigint, p double, late boolean")
        )
        held = save(flown.union(wait), "flown")
        settled = held.filter("p = 0 OR p = 1").select("key", F.col("p").cast("int").alias("chosen"))
        done = settled if done is None else done.union(settled)
    fixed = units.filter("p = 0 OR p = 1").select("key", F.col("p").cast("int").alias("chosen"))
    return fixed if done is None else fixed.union(done)


def mix_sources(
    sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``times``, how often the mix takes each row.

    A source's taken words miss its target by what the last level could not make up: less than a small document wherever a
    source has some to turn, more where it has but a few large ones.

    Defined cases: rows that agree in id, source and size are taken or left together. A null
    source is a source of its own, the last; a null id is an id; a null size is 0. Sources
    without words have target 0 and are not taken. Computed columns take the place of
    columns of their names. An empty table stays empty.
    """
    key = F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(source_col), F.col(source_col).isNull(), F.coalesce(F.col(size_col), F.lit(0)))
    keyed = sized.withColumn("_key", key)
    units = save(
        keyed.groupBy(
            F.col("_key").alias("key"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).alias("size")
        ).agg(F.count(F.lit(1)).alias("copies")),
        "units",
    )
    targets = save(source_targets(units, weights, share, most), "targets")
    named = targets.withColumnRenamed("source", "_s")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    with_p = save(
        units.join(named, F.col("source").eqNullSafe(F.col("_s"))).select(
            "key", "source", (F.col("size") * F.col("copies")).alias("weight"),
            F.floor(ratio).alias("_base"), (ratio - F.floor(ratio)).alias("p"), "source_size", "target",
        ),
        "probabilities",
    )
    chosen = balanced_sample(with_p.select("key", "source", "weight", "p"))
    times = save(
        with_p.join(chosen, "key").select(
            F.col("key").alias("_key"), "source_size", "target", (F.col("_base") + F.col("chosen")).cast("int").alias("times")
        ),
        "times",
    )
    kept = [c for c in keyed.columns if c not in ("source_size", "target", "times")]
    return keyed.select(*kept).join(times, "_key").drop("_key")
