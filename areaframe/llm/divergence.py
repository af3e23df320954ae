"""Source divergence audit: how a source's words differ from its language's.

Terms are counted per language and source in one pass. A kept term stands in enough documents of
its language. The share of a term in a group is smoothed and scaled to whole numbers, so all
arithmetic is exact: p = 1 + floor(scale * (count + 2) / (N + 2 * V)), and two shares diverge
by floor((p - q)**2 / (p + q)).

A group's top terms come from dominance: of two terms, one with no fewer occurrences in the group, no
more in the language and an earlier spelling always ranks first. Every partition keeps the terms that
fewer than k others dominate (a skyband), skybands of a group are merged into one, and only
what is left is ranked by its value.

All pairs of sources of a language are compared over all kept terms. Sources are dealt to tiles and
terms to parts, so a task holds two tiles and one part. It visits the terms that occur; those in neither
source add the same amount each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .shared import pieces, save
from .words import LOWER

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCALE = 1_000_000_000
#: Sources in a tile, terms in a part of a language, and rows held before a skyband is taken.
TILE, PART, HELD = 128, 4096, 1 << 17


def term_spans(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and of characters beyond ASCII; and each text's range of them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    begin = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    # A text's end closes its last term, also where the next text begins with a letter.
    both = marks[(marks > 0) & (marks < len(data))]
    both = both[inside[both] & inside[both + 1]]
    begin[both] = end[both] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, marks)


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs) over all rows; every group also has a row without term. Counted per run of texts first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, "text", 1 << 22):
            pairs = pc.binary_join_element_wise(rows.column(0).cast(pa.binary()), rows.column(1).cast(pa.binary()), b"\xff")
            coded = pairs.dictionary_encode()
            group = coded.indices.to_numpy(zero_copy_only=False)
            first = np.unique(group, return_index=True)[1]
            starts, ends, bounds = term_spans(data, marks)
            sizes = ends - starts
            letters = LOWER[data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]] if len(sizes) else data[:0]
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            terms = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
            code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            span = max(1, len(terms.dictionary))
            doc = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
            held, n = np.unique(doc * span + code, return_counts=True)
            at = group[held // span] * span + held % span
            keys, which = np.unique(at, return_inverse=True)
            total = np.bincount(which, n, len(keys)).astype(np.int64)
            in_docs = np.bincount(which, minlength=len(keys))
            row = np.r_[first[keys // span], first]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)),
                 pa.chunked_array([terms.dictionary.take(pa.array(keys % span)).cast(pa.string()), pa.nulls(len(first), pa.string())]).combine_chunks(),
                 pa.array(np.r_[total, np.zeros(len(first), np.int64)]), pa.array(np.r_[in_docs, np.zeros(len(first), np.int64)])],
                names=["lang", "source", "term", "n", "docs"],
            )

    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    long = slim.mapInArrow(task, "lang string, source string, term string, n bigint, docs bigint")
    return long.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def skyband(n: np.ndarray, against: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Which rows, in order of spelling, fewer than ``k`` earlier rows dominate: with no smaller ``n`` and no
    larger ``against``. Dominators that are themselves left out need not be counted: they have k dominators in the band, which dominate too."""
    keep = np.zeros(len(n), bool)
    band_n, band_a = n[:0], against[:0]
    for start in range(0, len(n), block):
        own = np.arange(start, min(start + block, len(n)))
        beaten = ((band_n >= n[own, None]) & (band_a <= against[own, None])).sum(1)
        own = own[beaten < k]
        inner = np.tril((n[own] >= n[own, None]) & (against[own] <= against[own, None]), -1).sum(1)
        own = own[((band_n >= n[own, None]) & (band_a <= against[own, None])).sum(1) + inner < k]
        keep[own] = True
        band_n, band_a = np.r_[band_n, n[own]], np.r_[band_a, against[own]]
    return keep


def group_skybands(entries: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, n, against) that are in the skyband of their group within their partition."""

    def banded(held: pa.Table) -> pa.Table:
        held = held.sort_by([("lang", "ascending"), ("source", "ascending"), ("term", "ascending")])
        same = [held.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("lang", "source")]
        edge = np.flatnonzero((np.diff(same[0]) != 0) | (np.diff(same[1]) != 0)) + 1
        n, against = held.column("n").to_numpy(), held.column("against").to_numpy()
        keep = [skyband(n[a:b], against[a:b], k) for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(n)])]
        return held.filter(pa.array(np.concatenate(keep)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, HELD
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                band = banded(pa.Table.from_batches(held))
                held, size = band.to_batches(), band.num_rows
                limit = max(HELD, 2 * size)
        if size:
            yield from banded(pa.Table.from_batches(held)).to_batches()

    return entries.select("lang", "source", "term", "n", "against").mapInArrow(task, "lang string, source string, term string, n bigint, against bigint")


def exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, in parts of ``SCALE``; 0 in a language without kept terms."""
    whole = exact(total) + exact(terms) * 2
    product = (exact(n) + 2) * exact(F.lit(SCALE))
    part = (product - product % F.greatest(whole, exact(F.lit(1)))) / F.greatest(whole, exact(F.lit(1)))
    return F.when(terms > 0, part.cast("bigint") + 1).otherwise(0)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)), exact: the square stays below 2**63."""
    squared, whole = (p - q) * (p - q), F.greatest(p + q, F.lit(1).cast("bigint"))
    return ((exact(squared) - exact(squared % whole)) / exact(whole)).cast("bigint")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def pair_block(entries: pa.Table, sources: pa.Table, crossing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the part's terms that either source has: the divergence of all pairs of the block's sources and the number of those terms."""
    names = sources.column("source").combine_chunks()
    p0 = sources.column("p0").to_numpy()
    tile = sources.column("tile").to_numpy()
    row = pc.index_in(entries.column("source").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = entries.column("term").combine_chunks().dictionary_encode()
    column = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    shape = (len(names), max(1, len(coded.dictionary)))
    p = np.repeat(p0[:, None], shape[1], 1)
    has = np.zeros(shape, bool)
    p[row, column], has[row, column] = entries.column("p").to_numpy(), True
    total, lacking = np.zeros((shape[0],) * 2, np.int64), np.zeros((shape[0],) * 2, np.int64)
    both = has.astype(np.float64) @ has.T.astype(np.float64)
    for i in range(shape[0]):
        mine = np.flatnonzero(has[i])
        found = divergence(p[i, mine], p[:, mine])
        total[i] = found.sum(1)
        lacking[i] = (found * ~has[:, mine]).sum(1)
    # Terms of i, and those of j that i lacks.
    value = total + lacking.T
    seen = has.sum(1)[:, None] + has.sum(1) - both.astype(np.int64)
    a, b = np.nonzero((tile[:, None] != tile) if crossing else ~np.eye(shape[0], dtype=bool))
    return a, b, value[a, b], seen[a, b]


def source_pairs(entries: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language. ``entries``: lang, source, term, p.
    ``groups``: lang, source, p0. ``langs``: lang, n_terms, n_sources."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n_sources") / TILE)).cast("int")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / PART)).cast("int")
    dealt = langs.select("lang", tiles.alias("tiles"), parts.alias("parts"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    low, high = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")

    def blocks(df: DataFrame, *columns: str) -> DataFrame:
        """A copy of every row for each block of two tiles that has its own."""
        placed = spread_join(df, dealt, "lang").withColumn("tile", tile)
        each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return each.withColumns({"low": low, "high": high}).select("lang", "low", "high", "tile", "parts", *columns)

    left = blocks(entries, "source", "term", "p").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    right = blocks(groups, "source", "p0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["lang", "low", "high", "part"]

    def task(some: tuple, entries: pa.Table, sources: pa.Table) -> pa.Table:
        a, b, value, seen = pair_block(entries, sources, some[1].as_py() != some[2].as_py())
        names = sources.column("source").combine_chunks()
        lang = pa.array([some[0].as_py()] * len(a), pa.string())
        return pa.Table.from_arrays([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value), pa.array(seen)],
                                    names=["lang", "source", "item", "value", "seen"])

    left, right = left.select(*key, "source", "term", "p"), right.select(*key, "source", "tile", "p0")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(task, "lang string, source string, item string, value bigint, seen bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_docs: int = 10, ranks: int = 10,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: every other source of the language.
    Part ``term``: the ``ranks`` terms that the source has more of than its language.

    Defined cases: null text, language and source read as ''. Terms are runs of ASCII letters and of characters beyond ASCII, only A-Z
    lower-cased. Rows that repeat count each. Equal values rank by the item's UTF-8. A group without terms, or of a language in which
    no term is kept, has its pairs (of value 0 where no term is kept) and no terms; the only source of a language has no pairs. Texts are read whole. Other columns are not
    read; an empty table gives none.
    """
    counts = save(term_counts(docs, lang_col, source_col, text_col), "terms")
    some = counts.filter("term IS NOT NULL")
    # One row per term of a language, with its sources: as many as the language has.
    terms = some.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("against"), F.collect_list(F.struct("source", "n")).alias("sources")
    ).filter(F.col("docs") >= least_docs)
    entries = save(terms.select("lang", "term", "against", F.inline("sources")), "entries")
    each = counts.select("lang", "source").distinct()
    in_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_term = entries.groupBy("lang", "term").agg(F.first("against").alias("against"))
    in_lang = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("against").alias("lang_total"))
    n_sources = each.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    langs = save(n_sources.join(in_lang, "lang", "left").na.fill(0), "langs")
    groups = each.join(in_group, ["lang", "source"], "left").na.fill(0)
    groups = spread_join(groups, langs.select("lang", "n_terms", "lang_total"), "lang")
    p0 = share(F.lit(0).cast("bigint"), F.col("total"), F.col("n_terms"))
    groups = save(groups.select("lang", "source", F.struct("lang", "source").alias("group"), "n_terms", "lang_total", "total", p0.alias("p0")), "groups")

    def with_p(df: DataFrame) -> DataFrame:
        totals = groups.select("group", "n_terms", "lang_total", "total")
        placed = spread_join(df.withColumn("group", F.struct("lang", "source")), totals, "group", "inner")
        return placed.withColumn("p", share(F.col("n"), F.col("total"), F.col("n_terms")))

    # Pairs.
    shares = save(with_p(entries).select("lang", "source", "term", "p"), "shares")
    pairs = source_pairs(shares, groups.select("lang", "source", "p0"), langs)
    mine = groups.select("group", F.col("p0").alias("own"), "n_terms")
    theirs = groups.select(F.col("group").alias("item_group"), F.col("p0").alias("other"))
    sided = pairs.withColumn("group", F.struct("lang", "source")).withColumn("item_group", F.struct("lang", F.col("item").alias("source")))
    sided = sided.join(mine, "group").join(theirs, "item_group")
    rest = gap(F.col("own"), F.col("other")) * (F.col("n_terms") - F.col("seen"))
    pair_rows = sided.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + rest).alias("value"))
    # Terms: skybands of partitions, merged per group, then exact values.
    local = group_skybands(entries, ranks)
    merged = save(group_skybands(local.repartition(F.col("lang"), F.col("source")), ranks), "skybands")
    valued = with_p(merged).withColumn("q", share(F.col("against"), F.col("lang_total"), F.col("n_terms"))).filter("p > q")
    term_rows = valued.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    top = term_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pair_rows.withColumn("rank", F.row_number().over(order)).unionByName(top)

