"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The state is a table of references (line key, document, count) and one cuckoo filter
per shard of keys. A new batch's keys are asked of the filters first; only keys that a
filter may hold are looked up in the exact table. A deletion writes negative counts and
takes a key out of its filter when no reference is left. Which lines are dropped
follows from the exact table alone, so a filter's false positives cost a lookup and
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .shared import extend, extended, pieces, save
from .words import Hasher, code_points, line_spans, strip

LEAST = 10
KEY = ["k1", "k2"]
KEYS_PER_SHARD = 100_000


def _keys(data: np.ndarray, marks: np.ndarray, least: int):
    """Line spans, their bounds by text, 128-bit keys, and which lines have a key: those of
    ``least`` code points or more between the spaces at their ends, A-Z as a-z."""
    starts, ends, bounds = line_spans(data, marks)
    a, b = strip(data, starts, ends)
    points = code_points(data)
    keyed = points[b] - points[a] >= least
    k1, k2 = (Hasher(data, lower=True, seed=s)(a, b).view(np.int64) for s in (1, 2))
    return starts, ends, bounds, k1, k2, keyed


def line_references(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(k1, k2, id, n): how often each document holds each key. Rows without an id have none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, "text"):
            _, _, bounds, k1, k2, keyed = _keys(data, marks, least)
            owner = np.repeat(np.arange(len(marks) - 1), np.diff(bounds))[keyed]
            k1, k2 = k1[keyed], k2[keyed]
            order = np.lexsort((k2, k1, owner))
            owner, k1, k2 = owner[order], k1[order], k2[order]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            at = np.flatnonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[at]), pa.array(k2[at]), rows.column(0).take(pa.array(owner[at])),
                 pa.array(np.diff(np.r_[at, len(owner)]))],
                names=["k1", "k2", "id", "n"],
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(task, f"k1 bigint, k2 bigint, id {kind}, n bigint")


@dataclass(frozen=True)
class LineIndex:
    """``deltas``: signed reference counts, one table per change; their sum is the exact
    table. ``filters``: (shard, bits). ``shards`` goes by the keys of the first insert, ``KEYS_PER_SHARD`` each, and
    :func:`compacted` sets it anew. ``taken_back``: whether any document was deleted."""

    deltas: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    taken_back: bool = False

    def references(self) -> DataFrame:
        """The exact table."""
        if len(self.deltas) == 1:
            return self.deltas[0].groupBy(*KEY, "id").agg(F.sum("n").alias("n"))
        rows = self.deltas[0]
        for more in self.deltas[1:]:
            rows = rows.union(more)
        return rows.groupBy(*KEY, "id").agg(F.sum("n").alias("n")).filter("n > 0")

    def shared(self) -> DataFrame:
        """Keys that two or more documents hold, with the smallest of these."""
        if self.taken_back:
            rows = self.references()
        else:
            # Minima and maxima do, without a row per document.
            rows = reduce(DataFrame.union, self.deltas)
        held = rows.groupBy(*KEY).agg(F.min("id").alias("owner"), F.max("id").alias("_last"))
        return held.filter("owner != _last").select(*KEY, "owner")


def empty_index(spark: SparkSession, id_type: str = "bigint", shards: int = 1) -> LineIndex:
    none = spark.createDataFrame([], f"k1 bigint, k2 bigint, id {id_type}, n bigint")
    return LineIndex((none,), spark.createDataFrame([], "shard int, bits binary"), shards)


def _shard(shards: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(shards)).cast("int")


def _filtered(keys: DataFrame, index: LineIndex, what: str) -> DataFrame:
    """Keys of a change beside their shard's filter: 'probe' tells which the filter may
    hold, 'insert' and 'remove' return the changed filters. Keys are distinct, so shards are even."""

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = left["k1"].to_numpy(np.int64)
        held = CuckooFilter.read(right["bits"].iloc[0]) if len(right) else None
        if what == "probe":
            hits = held.contains(keys) if held is not None and len(keys) else np.zeros(len(keys), bool)
            return left.loc[hits, KEY]
        shard = int((left if len(left) else right)["shard"].iloc[0])
        if what == "remove":
            if held is not None and len(keys):
                held.remove(keys)
        elif held is None:
            held = _built(keys)
        elif len(keys) and not held.insert(keys):
            held = None
        bits = None if held is None else held.write()
        return pd.DataFrame({"shard": [shard], "bits": [bits]})

    kind = "k1 bigint, k2 bigint" if what == "probe" else "shard int, bits binary"
    dealt = keys.select(_shard(index.shards).alias("shard"), *KEY)
    return dealt.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(task, kind)


def _built(keys: np.ndarray) -> CuckooFilter:
    """A filter with room for as many keys again, so that batches to come rarely ask for a larger one."""
    room = max(64, 2 * len(keys))
    while True:
        filled = CuckooFilter.sized(room)
        if filled.insert(keys):
            return filled
        room *= 2


def insert(index: LineIndex, references: DataFrame) -> LineIndex:
    """Takes in the references of new documents (from :func:`line_references`)."""
    added = save(references, "references")
    keys = save(added.select(*KEY).distinct(), "keys")
    if index.filters.isEmpty():
        index = replace(index, shards=max(1, -(-2 * keys.count() // KEYS_PER_SHARD)))
    maybe = save(_filtered(keys, index, "probe"), "maybe")
    if maybe.isEmpty():
        fresh = keys
    else:
        known = index.references().join(maybe, KEY, "left_semi").select(*KEY).distinct()
        fresh = keys.join(known, KEY, "left_anti")
    filters = save(_filtered(fresh, index, "insert"), "filters")
    changed = replace(index, deltas=(*index.deltas, added), filters=filters)
    if index.deltas[0].isEmpty() and len(index.deltas) == 1:
        changed = replace(changed, deltas=(added,))
    return compacted(changed) if not filters.filter("bits IS NULL").isEmpty() else changed


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """Takes documents back: as if they had never been inserted."""
    gone = ids.select(F.col(id_col).alias("id")).distinct()
    lost = save(
        index.references().join(gone, "id", "left_semi").select(*KEY, "id", (-F.col("n")).alias("n")),
        "references",
    )
    changed = replace(index, deltas=(*index.deltas, lost), taken_back=True)
    touched = lost.select(*KEY).distinct()
    left = changed.references().join(touched, KEY, "left_semi").select(*KEY).distinct()
    dead = touched.join(left, KEY, "left_anti")
    return replace(changed, filters=save(_filtered(dead, index, "remove"), "filters"))


def compacted(index: LineIndex) -> LineIndex:
    """One table of references, and filters built from it with shards to its measure."""
    rows = save(index.references(), "references")
    keys = save(rows.select(*KEY).distinct(), "keys")
    shards = max(1, -(-2 * keys.count() // KEYS_PER_SHARD))
    new = LineIndex((rows,), index.filters.limit(0), shards, index.taken_back)
    return replace(new, filters=save(_filtered(keys, new, "insert"), "filters"))


def drop_lines(
    docs: DataFrame, shared: DataFrame, references: DataFrame, id_col: str, text_col: str, least: int = LEAST
) -> DataFrame:
    """``docs`` without the lines whose key a smaller document holds; ``n_lines`` counts
    lines before, ``n_dropped`` those that went."""
    added = {text_col: "string", "n_lines": "bigint", "n_dropped": "bigint"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, text_col):
            lists = rows.column(rows.schema.get_field_index("_drop"))
            starts, ends, bounds, k1, k2, keyed = _keys(data, marks, least)
            texts = rows.column(rows.schema.get_field_index(text_col))
            dropped = np.zeros(rows.num_rows, np.int64)
            changed: dict[int, str] = {}
            for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                pairs = np.array(sorted((x["k1"], x["k2"]) for x in lists[i].as_py()), np.int64)
                own = slice(bounds[i], bounds[i + 1])
                at = np.minimum(np.searchsorted(pairs[:, 0], k1[own]), len(pairs) - 1)
                hit = keyed[own] & (pairs[at, 0] == k1[own]) & (pairs[at, 1] == k2[own])
                dropped[i] = hit.sum()
                if dropped[i]:
                    left = [data[s:e].tobytes() for s, e in zip(starts[own][~hit], ends[own][~hit])]
                    changed[i] = b"\n".join(left).decode()
            if changed:
                listed = texts.to_pylist()
                for i, text in changed.items():
                    listed[i] = text
                texts = pa.array(listed, texts.type)
            out = {text_col: texts, "n_lines": pa.array(np.diff(bounds)), "n_dropped": pa.array(dropped)}
            yield extend(rows, out, ("_drop",))

    kept = [c for c in docs.columns if c not in ("_drop", "_id")]
    lists = (
        references.join(shared, KEY).filter("id != owner")
        .groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("_drop"))
    )
    joined = docs.select(*kept).join(lists, F.col(id_col) == F.col("_id"), "left").select(*kept, "_drop")
    return joined.mapInArrow(task, extended(docs.select(*kept), added))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST
) -> DataFrame:
    """All documents with repeated lines dropped wherever a smaller id holds them.

    Defined cases: a null or empty text is one empty line and stays as it is. Rows
    without an id neither give nor lose lines. Rows that share an id are one document:
    its lines never drop each other. ``n_lines`` and ``n_dropped`` take the place of
    columns of these names; other columns pass through. An empty table stays empty.
    """
    references = save(line_references(docs, id_col, text_col, least), "all")
    index = empty_index(docs.sparkSession, docs.schema[id_col].dataType.simpleString())
    # In two batches: the second's keys are asked of the filters that the first has filled.
    half = F.pmod(F.xxhash64("id", F.lit(43)), F.lit(2))
    for batch in range(2):
        index = insert(index, references.filter(half == batch))
    shared = save(index.shared(), "shared")
    return drop_lines(docs, shared, references, id_col, text_col, least)
