"""MinHash near-duplicates: many universal hash minima, bands, signatures, full sets.

1. One pass gives each document its set of word shingles, reduced to a fingerprint and
   the hashes of its bands. Equal sets are one class from here on.
2. Classes that share a band hash are tied to the smallest class of that bucket; the
   components of these ties are candidate groups. Links can only lie inside a group.
3. Groups are checked on full sets: signatures first, then intersections, skipping
   pairs whose components have met. Groups beyond ``block`` classes are cut into
   blocks: all blocks meet the first, and whatever is then outside the group's largest
   component meets every block. A link between two components has an end outside the
   largest, so no link is lost, and no pair is ever a row.
4. Components of the links found by alternating large-star and small-star.

Every join is merged, at every size: each side grows with the corpus, and as a broadcast it would lie in the driver's
memory, for small corpora only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import binaries, pieces, runs, save
from .words import Hasher, U, mix, word_spans


@dataclass(frozen=True)
class MinHash:
    """``percent``: least similarity in hundredths. ``bands`` of ``rows`` minima: a pair
    at similarity 0.8 shares no band with a chance of (1 - 0.8**rows)**bands, 3e-6 with the
    values given. ``margin``: how far below the limit an estimate from
    signatures may lie before the full sets are left alone (5 standard deviations)."""

    shingle: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    margin: float = 0.13
    block: int = 256

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(1, self.bands * self.rows + 1, dtype=np.uint64)
        return mix(n * U(0x9E3779B97F4A7C15)) | U(1), mix(n * U(0xC2B2AE3D27D4EB4F))


def shingle_sets(
    data: np.ndarray, marks: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text, one text after
    the other, and their bounds. A text of fewer words has its whole sequence as one."""
    starts, ends, bounds = word_spans(data, marks)
    words = Hasher(data, lower=True)(starts, ends)
    rolled = np.zeros(len(words), np.uint64)
    for j in range(k):
        part = words[j:] * U(pow(0x9FB21C651E98DF25, j + 1, 2**64))
        rolled[: len(part)] += part
    rolled = mix(rolled)
    sets, sizes = [], np.zeros(len(marks), np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= k:
            own = np.unique(rolled[a : b - k + 1])
        elif b > a:
            factors = [pow(0x9FB21C651E98DF25, j + 1, 2**64) for j in range(b - a)]
            own = mix((words[a:b] * np.array(factors, np.uint64)).sum(keepdims=True) + U(b - a))
        else:
            continue
        sets.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def minima(sets: np.ndarray, bounds: np.ndarray, p: MinHash) -> np.ndarray:
    """(texts, hashes) minima; rows of empty sets are zero."""
    a, b = p.multipliers()
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((len(bounds) - 1, len(a)), np.uint64)
    if len(full):
        at, work = bounds[:-1][full], np.empty_like(sets)
        for j in range(len(a)):
            np.multiply(sets, a[j], out=work)
            np.add(work, b[j], out=work)
            out[full, j] = np.minimum.reduceat(work, at)
    return out


def _banded(text: str, p: MinHash):
    factors = np.array([pow(0xA24BAED4963EE407, j + 1, 2**64) for j in range(p.rows)], np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, text):
            sets, bounds = shingle_sets(data, marks, p.shingle)
            low = minima(sets, bounds, p) >> U(32)
            keys = (low.reshape(-1, p.bands, p.rows) * factors).sum(axis=2)
            keys = mix(keys + np.arange(1, p.bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
            sums = np.zeros((2, len(sets) + 1), np.uint64)
            np.cumsum(sets, out=sums[0, 1:])
            np.cumsum(mix(sets ^ U(0x5851F42D4C957F2D)), out=sums[1, 1:])
            s1, s2 = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
            n = np.diff(bounds)
            flat = pa.array(keys.view(np.int64).ravel())
            cuts = pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.bands)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n), pa.array(s1), pa.array(s2),
                 pa.ListArray.from_arrays(cuts, flat)],
                names=["id", "th", "n", "s1", "s2", "bands"],
            )

    return task


def _full_sets(text: str, p: MinHash):
    """The sets and signatures of the classes that are in a group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, text):
            sets, bounds = shingle_sets(data, marks, p.shingle)
            low = (minima(sets, bounds, p) >> U(48)).astype(np.uint16)
            cut = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:4], pa.array(np.diff(bounds)),
                 pa.array(cut, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())],
                names=["cid", "grp", "block", "blocks", "n", "items", "signature"],
            )

    return task


def _links(p: MinHash):
    """Links inside each unit of work: enough to join all that is joined there. Rows
    bring ``part``, the component known before (none: the class itself)."""

    def solve(t: pa.Table) -> tuple[list, list]:
        order = np.argsort(t["n"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ids = t["cid"].to_numpy()
        n = t["n"].to_numpy()
        sides = t["side"].to_numpy()
        sets = binaries(t["items"], np.uint64)
        signatures = np.stack(binaries(t["signature"], np.uint16))
        root = np.arange(len(ids))
        first: dict[int, int] = {}
        for i, part in enumerate(t["part"].to_numpy().tolist()):
            root[i] = first.setdefault(part, i)

        a, b = [], []
        within = sides.max() == 0
        for i in range(len(ids)):
            stop = int(np.searchsorted(n, n[i] * 100 // p.percent, "right"))
            reach = np.arange(i + 1, stop)
            if not within:
                reach = reach[(sides[reach] != sides[i])]
            reach = reach[root[reach] != root[i]]
            if not len(reach):
                continue
            alike = (signatures[reach] == signatures[i]).mean(axis=1)
            good = alike >= p.percent / 100 - p.margin
            for j in reach[good][np.argsort(-alike[good], kind="stable")].tolist():
                if root[i] == root[j]:
                    continue
                where = np.searchsorted(sets[j], sets[i])
                where[where == len(sets[j])] = 0
                both = int((sets[j][where] == sets[i]).sum())
                if 100 * both >= p.percent * (n[i] + n[j] - both):
                    a.append(ids[i])
                    b.append(ids[j])
                    root[root == root[j]] = root[i]
        return a, b

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit"):
            units = table["unit"].to_numpy()
            cuts = np.flatnonzero(units[1:] != units[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)]):
                if e - s > 1:
                    a, b = solve(table.slice(s, e - s))
                    if a:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
                        )

    return task


def _solved(units: DataFrame, p: MinHash) -> DataFrame:
    """Runs :func:`_links` on rows dealt by ``unit``; a unit holds two blocks at most."""
    columns = ["unit", "side", "cid", "part", "n", "items", "signature"]
    dealt = units.select(*columns).repartition("unit").sortWithinPartitions("unit", "cid")
    return dealt.mapInArrow(_links(p), "a bigint, b bigint")


def _unit(*columns):
    return F.xxhash64(*columns)


def links(docs: DataFrame, id_col: str, text_col: str, p: MinHash) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: id, set size, class; and (node, component) for classes that any chain of
    links joins to others."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    rows = save(
        slim.mapInArrow(
            _banded("text", p),
            f"id {slim.schema['id'].dataType.simpleString()}, th bigint, n bigint, s1 bigint, "
            "s2 bigint, bands array<bigint>",
        ).withColumn("cid", F.xxhash64("n", "s1", "s2")),
        "shingled",
    )
    some = rows.filter("n > 0")
    # One row per class and task before the exchange; the band hashes are the set's own.
    classes = save(
        some.groupBy("cid").agg(
            F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("rep"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    leaders = save(
        keyed.groupBy("key").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("key", "leader"),
        "leaders",
    )
    ties = keyed.join(leaders.hint("merge"), "key").filter("cid != leader").select("cid", "leader").distinct()
    groups = components(ties).select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    sizes = save(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    placed = save(
        groups.join(sizes.hint("merge"), "grp").join(classes.select("cid", "rep").hint("merge"), "cid").select(
            "cid", "rep", "grp", blocks.alias("blocks"),
            F.pmod(F.xxhash64("cid", F.lit(17)), blocks).cast("int").alias("block"),
        ),
        "placed",
    )
    # The text of one document of each class; its hash tells rows of one id apart.
    wanted = placed.select(
        F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"), "cid", "grp", "block", "blocks"
    )
    chosen = slim.join(
        wanted.hint("merge"), (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id"))
    )
    sets = save(
        chosen.select("cid", "grp", "block", "blocks", "text").mapInArrow(
            _full_sets("text", p),
            "cid bigint, grp bigint, block int, blocks int, n bigint, items binary, signature binary",
        ),
        "sets",
    )
    return rows, _checked(sets, placed, p)


def _checked(sets: DataFrame, placed: DataFrame, p: MinHash) -> DataFrame:
    none = F.col("cid").alias("part")
    whole = sets.filter("blocks = 1").select(
        _unit("grp").alias("unit"), F.lit(0).alias("side"), "cid", none, "n", "items", "signature"
    )
    found = save(_solved(whole, p), "links")
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return components(found)
    # The first block meets every block; a block also meets itself.
    wide = sets.filter("blocks > 1")
    others = wide.select(
        _unit("grp", "block").alias("unit"), F.lit(0).alias("side"), "cid", none, "n", "items", "signature"
    )
    first = wide.filter("block = 0").withColumn("_to", F.explode(F.expr("sequence(1, blocks - 1)"))).select(
        _unit("grp", "_to").alias("unit"), F.lit(0).alias("side"), "cid", none, "n", "items", "signature"
    )
    found = save(found.union(_solved(others.union(first), p)), "links")
    # What is outside the largest component of its group meets every block.
    known = save(components(found), "known")
    parts = save(
        large.join(known.hint("merge"), large["cid"] == known["node"], "left").select(
            "cid", "grp", "block", "blocks", F.coalesce("component", "cid").alias("part")
        ),
        "parts",
    )
    shares = save(parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_n")), "shares")
    largest = shares.groupBy("grp").agg(
        F.max(F.struct("_n", "part")).alias("_top"), F.sum("_n").alias("_all")
    ).select("grp", F.col("_top.part").alias("main"), (F.col("_all") - F.col("_top._n")).alias("outside"))
    outside = save(
        parts.join(save(largest, "largest").hint("merge"), "grp").filter("part != main").select(
            "cid", F.pmod(
                F.xxhash64("cid", F.lit(23)), F.ceil(F.col("outside") / p.block)
            ).cast("int").alias("pack"),
            "grp", "part", "blocks",
        ),
        "outside",
    )
    if outside.isEmpty():
        return known
    packs = outside.select("grp", "pack").distinct()
    numbered = wide.select("cid", "n", "items", "signature")
    left = numbered.join(
        outside.withColumn("_to", F.explode(F.expr("sequence(0, blocks - 1)"))).hint("merge"), "cid"
    ).select(_unit("grp", "pack", "_to").alias("unit"), F.lit(1).alias("side"), "cid", "part", "n", "items", "signature")
    right = numbered.join(parts.select("cid", "grp", "block", "part").hint("merge"), "cid").join(
        save(packs, "packs").hint("merge"), "grp"
    ).select(_unit("grp", "pack", "block").alias("unit"), F.lit(0).alias("side"), "cid", "part", "n", "items", "signature")
    more = _solved(left.union(right), p)
    # What is new joins components that are known; only these are gone through again.
    named = save(parts.select("cid", F.col("part")), "named")
    ends = (
        save(more, "links").join(named.select(F.col("cid").alias("a"), F.col("part").alias("pa")).hint("merge"), "a")
        .join(named.select(F.col("cid").alias("b"), F.col("part").alias("pb")).hint("merge"), "b").select("pa", "pb")
    )
    met = save(components(ends), "met")
    outer = parts.select(F.col("cid").alias("node"), F.col("part").alias("component"))
    inner = known.join(large.select("cid").hint("merge"), F.col("node") == F.col("cid"), "left_anti")
    renamed = outer.join(
        met.select(F.col("node").alias("component"), F.col("component").alias("_to")).hint("merge"), "component", "left"
    )
    return inner.select("node", "component").union(renamed.select("node", F.coalesce("_to", "component")))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHash = MinHash()
) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``th``) of the documents that stay when each component keeps one: that with the smallest
    id, then the smallest hash of its text; ids that are there go before null ones. ``th`` is ``xxhash64`` of the text, so rows that share an id are told
    apart. Documents without words all stay. The second table has those that stay and stand in the table more than once, words or not counted."""
    rows, joined = links(docs, id_col, text_col, params)
    worded = rows.filter("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    parts = worded.groupBy("cid").agg(first.alias("rep")).join(joined.hint("merge"), F.col("cid") == F.col("node"), "left")
    best = parts.groupBy(F.coalesce("component", "cid").alias("part")).agg(F.min("rep").alias("rep"))
    stay = save(best.select("rep.id", "rep.th").union(rows.filter("n = 0").select("id", "th").distinct()), "stay")
    often = worded.groupBy("id", "th").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col("id").alias("_id"), F.col("th").alias("_th")
    )
    same = (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id"))
    return stay, save(stay.join(often.hint("merge"), same, "left_semi"), "repeated")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHash = MinHash()
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` (the smallest
    id of all documents that a chain of links reaches) and ``kept``.

    Defined cases: a null or wordless text has an empty set, links with nothing and is
    its own component. Repeated rows are copies of each other. A null id takes part,
    is never a component's name while another id is there, and is kept only where it is
    alone without one. Other columns are not read; an empty table gives no rows.
    """
    # Components are named by class; their smallest document id is looked up after.
    rows, joined = links(docs, id_col, text_col, params)
    parts = save(
        rows.filter("n > 0").groupBy("cid").agg(F.min("id").alias("rep"))
        .join(joined.hint("merge"), F.col("cid") == F.col("node"), "left")
        .select("cid", "rep", F.coalesce("component", "cid").alias("part")),
        "parts",
    )
    names = save(parts.groupBy("part").agg(F.min("rep").alias("name")), "names")
    named = save(parts.join(names.hint("merge"), "part").select("cid", "name"), "named")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(
        named.hint("merge"), "cid", "left"
    )
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        name.alias("component_id"),
        F.col("id").eqNullSafe(name).alias("kept"),
    )
