"""Embedding near-duplicates by NN-descent.

Vectors of one label are compared by cosine. Exact copies are one node. Each node keeps a
list of its nearest nodes so far; a round joins every node's neighbours with each other
(neighbours of neighbours), in both directions. Lists that are all links are saturated and
grow. Links then tie nodes to components. A component larger than a list may hide its links
to others, since its nodes list each other: such components are compared with each other
exactly, in balls whose distance rules most of them out. Recall is audited against brute force on
a bounded set of nodes; while it is short, fresh orders and rounds go on, and a warning tells
when they do not reach it. Each component's links are counted block by block, so that a large
group needs no list of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import runs, save


@dataclass(frozen=True)
class Descent:
    """``least``: cosine of a link. ``listed``: length of a neighbour list; ``trees`` random
    hyperplane orders start it. ``audited``: nodes compared with all others for ``recall``; ``more``: how
    often fresh orders are added while it is short; ``dealt``: nodes in a partition of an order at most."""

    least: float = 0.93
    listed: int = 8
    longest: int = 32
    trees: int = 4
    rounds: int = 8
    audited: int = 200
    recall: float = 0.99
    block: int = 256
    more: int = 8
    dealt: int = 4096


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles of length one, from binary."""
    rows = np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])
    return rows


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, node) and nodes (node, space, copies, unit). A vector that is null, zero or not all
    finite, or has no label, has no node. Vectors are compared only within their space: equal label
    and width. Equal unit vectors in a space are one node, named by a hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for vector in batch.column(1).to_pylist():
                unit = None
                if vector and None not in vector:
                    x = np.array(vector, np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()
                        unit = (x / np.sqrt((x * x).sum())).tobytes()
                units.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(units, pa.binary())], names=["id", "label", "unit"]
            )

    slim = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")
    )
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = save(
        slim.mapInArrow(task, f"id {kind}, label string, unit binary").withColumn(
            "node", F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "unit"))
        ),
        "vectors",
    )
    nodes = save(
        rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"),
            F.first("unit").alias("unit"), F.first("label").alias("label"),
        ).withColumn("space", F.xxhash64("label", F.length("unit"))).drop("label"),
        "nodes",
    )
    return rows.select("id", "node"), nodes


def _top(pairs: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of each list; ranks are limited before the exchange as well as after it."""
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return pairs.distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).drop("_r")


def _both(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[a, b]), pa.array(np.r_[b, a]), pa.array(np.r_[c, c])], names=["u", "v", "cos"]
    )


def _best_within(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``keep`` others of each row of a small company."""
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    keep = min(keep, len(ids) - 1)
    if keep < 1:
        return ids[:0], ids[:0], cos[:0, 0]
    at = np.argpartition(-cos, keep - 1, axis=1)[:, :keep]
    return np.repeat(ids, keep), ids[at].ravel(), np.take_along_axis(cos, at, 1).ravel()


def _start(nodes: DataFrame, p: Descent, since: int = 0) -> DataFrame:
    """First lists, by the orders from number ``since``: in each random hyperplane order of a space, companies of nodes side by side.

    Partitions go by rows: some thousands at most, which is what a task holds, and some companies at least, so that a small table is not dealt
    into pieces of single nodes."""
    rows, cores = nodes.count(), nodes.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-rows // p.dealt), min(2 * cores, rows // 512))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "space"):
            # What a partition holds of a space, cut in companies; the order is by the code.
            ids, spaces = table["node"].to_numpy(), table["space"].to_numpy()
            cuts = np.flatnonzero(spaces[1:] != spaces[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                x = _units(table["unit"].slice(s, e - s))
                for a in range(0, e - s, 64):
                    own = slice(max(0, a - 32), a + 64)
                    u, v, c = _best_within(ids[s:e][own], x[own], p.listed)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(c)], names=["u", "v", "cos"])

    def coded(tree: int):
        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                units = [np.frombuffer(x, np.float64) for x in batch.column(2).to_pylist()]
                codes = np.zeros(len(units), np.int64)
                for width in {len(x) for x in units}:
                    at = [i for i, x in enumerate(units) if len(x) == width]
                    planes = np.random.default_rng([tree, width]).standard_normal((width, 24))
                    bits = (np.stack([units[i] for i in at]) @ planes > 0).astype(np.int64)
                    codes[at] = (bits << np.arange(23, -1, -1)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["node", "space", "unit", "code"])

        slim = nodes.select("node", "space", "unit").mapInArrow(code, "node bigint, space bigint, unit binary, code bigint")
        # Ranges of (space, code): a space, however large, is many partitions.
        return slim.repartitionByRange(parts, "space", "code", "node").sortWithinPartitions("space", "code", "node").select(
            "node", "space", "unit"
        ).mapInArrow(task, "u bigint, v bigint, cos double")

    pairs = coded(since)
    for tree in range(since + 1, since + p.trees):
        pairs = pairs.union(coded(tree))
    return pairs


def _local_join(p: Descent):
    """Neighbours of one node compared with each other, many nodes at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "w"):
            w, ids = table["w"].to_numpy(), table["node"].to_numpy()
            units = table["unit"].to_pylist()
            cuts = np.flatnonzero(w[1:] != w[:-1]) + 1
            out = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(w)]):
                if e - s > 1:
                    x = np.frombuffer(b"".join(units[s:e]), np.float64).reshape(e - s, -1)
                    out.append(_best_within(ids[s:e], x, p.listed))
            if out:
                u, v, c = (np.concatenate(k) for k in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(c)], names=["u", "v", "cos"])

    return task


def _round(lists: DataFrame, nodes: DataFrame, p: Descent) -> DataFrame:
    """One step: for each node its list, the nodes that list it (as many again), and itself meet."""
    back = Window.partitionBy("w").orderBy(F.xxhash64("node", "w"))
    listed = lists.select(F.col("u").alias("w"), F.col("v").alias("node"))
    listing = (
        lists.select(F.col("v").alias("w"), F.col("u").alias("node")).withColumn("_r", F.row_number().over(back))
        .filter(F.col("_r") <= p.listed).drop("_r")
    )
    own = nodes.select(F.col("node").alias("w"), "node")
    meet = save(listed.union(listing).union(own).distinct(), "meetings")
    dealt = meet.join(nodes.select("node", "unit"), "node").repartition("w").sortWithinPartitions("w", "node")
    return dealt.select("w", "node", "unit").mapInArrow(_local_join(p), "u bigint, v bigint, cos double")


def _audit(nodes: DataFrame, p: Descent) -> DataFrame:
    """All links of ``audited`` nodes (those of smallest hash), by brute force: their vectors, a number
    that does not grow, go to every task."""
    some = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(p.audited).select("node", "space", "unit").toPandas()
    spaces = {}
    for node, space, unit in some.itertuples(index=False):
        spaces.setdefault(space, []).append((node, np.frombuffer(unit, np.float64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            units = batch.column(2).to_pylist()
            for space, asked in spaces.items():
                at = np.flatnonzero(own == space)
                if len(at):
                    x = np.stack([np.frombuffer(units[i], np.float64) for i in at])
                    q = np.array([a for a, _ in asked])
                    cos = np.stack([a for _, a in asked]) @ x.T
                    i, j = np.nonzero((cos >= p.least) & (q[:, None] != ids[at][None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(ids[at][j])], names=["u", "v"])

    return nodes.select("node", "space", "unit").mapInArrow(task, "u bigint, v bigint")


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Middle and radius, an angle, of the vectors of each ball."""
    for table in runs(batches, "ball"):
        balls, spaces, parts = (table[c].to_numpy() for c in ("ball", "space", "part"))
        cuts = np.flatnonzero(balls[1:] != balls[:-1]) + 1
        starts = [0, *cuts.tolist()]
        middles, radii = [], []
        for s, e in zip(starts, [*starts[1:], len(balls)]):
            x = _units(table["unit"].slice(s, e - s))
            middle = x.sum(axis=0)
            length = np.sqrt((middle * middle).sum())
            middle = middle / length if length > 1e-9 else x[0]
            middles.append(middle.tobytes())
            radii.append(float(np.arccos(np.clip(x @ middle, -1, 1)).max()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(balls[starts]), pa.array(spaces[starts]), pa.array(parts[starts]), pa.array(radii), pa.array(middles, pa.binary())],
            names=["ball", "space", "part", "radius", "unit"],
        )


def _visits(p: Descent):
    """Which nodes may link into which ball of another component. Of two balls the wider one's nodes visit."""
    reach = float(np.arccos(p.least)) + 1e-6

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit_id"):
            groups = table["unit_id"].to_numpy()
            cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            side, node, ball, part, radius = (table[c].to_numpy() for c in ("side", "node", "ball", "part", "radius"))
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)]):
                a, b = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                if not len(a) or not len(b):
                    continue
                x = _units(table["unit"].slice(s, e - s))
                angle = np.arccos(np.clip(x[a - s] @ x[b - s].T, -1, 1))
                wider = (radius[a][:, None] > radius[b]) | ((radius[a][:, None] == radius[b]) & (ball[a][:, None] > ball[b]))
                i, j = np.nonzero(wider & (part[a][:, None] != part[b]) & (angle <= reach + radius[b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[a][i]), pa.array(ball[a][i]), pa.array(ball[b][j])], names=["node", "ball", "host"]
                )

    return task


def _bridge(p: Descent):
    """The closest pair of a ball's visitors from another ball and its own nodes, if it is a link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit_id"):
            groups = table["unit_id"].to_numpy()
            cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            side, node = table["side"].to_numpy(), table["node"].to_numpy()
            u, v = [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)]):
                asks, told = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
                x = _units(table["unit"].slice(s, e - s))
                cos = x[asks] @ x[told].T
                if cos.size and cos.max() >= p.least:
                    i, j = np.unravel_index(cos.argmax(), cos.shape)
                    u.append(node[s + asks[i]])
                    v.append(node[s + told[j]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return task


def _bridges(nodes: DataFrame, parts: DataFrame, p: Descent) -> DataFrame:
    """A link (u, v) for every two balls of different components that have one, among the components of more
    nodes than a list holds: a smaller one's nodes have room for others in their lists. Exact; what one task
    holds is bounded by blocks, however large spaces and components are."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > p.listed)
    held = parts.select("node", "part").join(sizes, "part").join(nodes.select("node", "space", "unit"), "node")
    # A space with one such component has nothing to compare.
    several = held.groupBy("space").agg(F.countDistinct("part").alias("_p"), F.count(F.lit(1)).alias("_s")).filter("_p > 1")
    blocks = F.ceil(F.col("_n") / p.block).cast("bigint")
    held = save(
        held.join(several, "space").withColumn("ball", F.xxhash64("part", F.pmod(F.xxhash64("node", F.lit(43)), blocks)))
        .select("node", "space", "part", "ball", "unit", F.ceil(F.col("_s") / 1024).cast("int").alias("cuts")),
        "held",
    )
    balls = save(
        held.select("ball", "space", "part", "unit").repartition("ball").sortWithinPartitions("ball")
        .mapInArrow(_balls, "ball bigint, space bigint, part bigint, radius double, unit binary"),
        "balls",
    )
    cuts = held.groupBy("space").agg(F.first("cuts").alias("cuts"))
    ball_cuts = balls.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / 1024).cast("int").alias("ball_cuts"))
    grid = cuts.join(ball_cuts, "space")
    i = F.pmod(F.xxhash64("node", F.lit(47)), F.col("cuts")).cast("int")
    j = F.pmod(F.xxhash64("ball", F.lit(47)), F.col("ball_cuts")).cast("int")
    asks = (
        held.join(balls.select("ball", "radius"), "ball").drop("cuts").join(grid, "space").withColumn("i", i)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ball_cuts") - 1)))
        .select(F.xxhash64("space", "i", "j").alias("unit_id"), F.lit(0).alias("side"), "node", "ball", "part", "radius", "unit")
    )
    told = (
        balls.join(grid, "space").withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(
            F.xxhash64("space", "i", "j").alias("unit_id"), F.lit(1).alias("side"), F.col("ball").alias("node"),
            "ball", "part", "radius", "unit",
        )
    )
    visits = save(
        asks.union(told).repartition("unit_id").sortWithinPartitions("unit_id", "side", "node")
        .mapInArrow(_visits(p), "node bigint, ball bigint, host bigint"),
        "visits",
    )
    unit_id = F.xxhash64("ball", "host").alias("unit_id")
    guests = visits.select(unit_id, F.lit(0).alias("side"), "node").join(held.select("node", "unit"), "node")
    hosts = visits.select("ball", "host").distinct().select(unit_id, F.lit(1).alias("side"), "host").join(
        held.select(F.col("ball").alias("host"), "node", "unit"), "host"
    )
    columns = ["unit_id", "side", "node", "unit"]
    return (
        guests.select(columns).union(hosts.select(columns)).repartition("unit_id").sortWithinPartitions("unit_id", "side", "node")
        .mapInArrow(_bridge(p), "u bigint, v bigint")
    )


def _counted(p: Descent):
    """Links between two blocks of one component: per node how many vectors it links there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit_id"):
            groups = table["unit_id"].to_numpy()
            cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            ids, side, copies = (table[c].to_numpy() for c in ("node", "side", "copies"))
            units = table["unit"].to_pylist()
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                x = np.frombuffer(b"".join(units[s:e]), np.float64).reshape(e - s, -1)
                asks, told = side[s:e] == 0, side[s:e] == 1
                links = (x[asks] @ x[told].T >= p.least) | (ids[s:e][asks][:, None] == ids[s:e][told][None, :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s:e][asks]), pa.array(links @ copies[s:e][told])], names=["node", "n"]
                )

    return task


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: Descent = Descent()
) -> tuple[DataFrame, dict[str, float]]:
    """Per vector ``n_links``, ``component_id`` and ``kept``; and the audit's recall and number of rounds.

    Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose
    label is null, links with nothing. Copies link with each other. Vectors of different
    width never link. A recall that stays short after all fresh orders stops the job. A null id counts as a vector and names no component while another id is
    there. Rows that share an id are vectors each. An empty table gives no rows.
    """
    p = params
    rows, nodes = nodes_of(vectors, id_col, vector_col, label_col)
    report = {"recall": 1.0, "rounds": 0}
    lists = save(_top(_start(nodes, p), p.listed), "lists")
    links = save(lists.filter(F.col("cos") >= p.least).select("u", "v"), "links")
    truth = save(_audit(nodes, p), "audit")
    wanted = truth.count()

    def tied() -> DataFrame:
        return save(
            nodes.select("node", "copies", "first").join(components(links), "node", "left")
            .withColumn("part", F.coalesce("component", "node")).drop("component"), "parts",
        )

    for more in range(p.more + 1):
        if more:
            fresh = _start(nodes, p, more * p.trees)
            links = save(links.union(fresh.filter(F.col("cos") >= p.least).select("u", "v")).distinct(), "links")
            lists = save(_top(lists.union(fresh), p.longest), "lists")
        for _ in range(p.rounds):
            met = save(_round(lists, nodes, p), "met")
            grown = lists.groupBy("u").agg((F.min("cos") >= p.least).alias("full"))
            new = _top(lists.union(met), p.longest).join(grown, "u", "left")
            # A saturated list may be longer; the others keep their best.
            rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
            new = save(
                new.withColumn("_r", rank).filter((F.col("_r") <= p.listed) | F.coalesce("full", F.lit(False)))
                .select("u", "v", "cos"), "lists",
            )
            links = save(
                links.union(new.filter(F.col("cos") >= p.least).select("u", "v"))
                .union(met.filter(F.col("cos") >= p.least).select("u", "v")).distinct(), "links",
            )
            changed = new.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
            total = new.count()
            lists = new
            report["rounds"] += 1
            if changed <= 0.02 * total:
                break
        parts = tied()
        bridges = save(_bridges(nodes, parts, p), "bridges")
        if bridges.count():
            links = save(links.union(bridges), "links")
            parts = tied()
        if not wanted:
            break
        ends = parts.select("node", "part")
        joined = truth.join(ends, truth["u"] == ends["node"]).select("u", "v", F.col("part").alias("pu")).join(
            ends, F.col("v") == ends["node"]
        )
        report["recall"] = joined.filter("pu = part").count() / wanted
        if report["recall"] >= p.recall:
            break
    if report["recall"] < p.recall:
        raise RuntimeError(f"audited recall {report['recall']:.4f} stays below {p.recall}: more rounds, orders or longer lists are needed")
    if report["recall"] < 1:
        # What the audit found is true as well.
        links = save(links.union(truth), "links")
        parts = tied()
    sizes = save(
        parts.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.min("first").alias("component_id")), "sizes"
    )
    placed = save(
        parts.join(sizes, "part").withColumn("blocks", F.ceil(F.col("_n") / p.block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(41)), F.col("blocks")).cast("int")),
        "placed",
    )
    alone = placed.filter("_n = 1").select("node", F.col("copies").alias("n"))
    many = placed.filter("_n > 1").join(nodes.select("node", "unit"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = many.withColumn("_o", other).select(
        F.xxhash64("part", "block", "_o").alias("unit_id"), F.lit(0).alias("side"), "node", "copies", "unit"
    )
    told = many.withColumn("_o", other).select(
        F.xxhash64("part", "_o", "block").alias("unit_id"), F.lit(1).alias("side"), "node", "copies", "unit"
    )
    counted = (
        asks.union(told).repartition("unit_id").sortWithinPartitions("unit_id", "side", "node")
        .mapInArrow(_counted(p), "node bigint, n bigint")
    )
    degrees = save(alone.union(counted).groupBy("node").agg((F.sum("n") - 1).alias("n_links")), "degrees")
    found = save(placed.select("node", "component_id").join(degrees, "node"), "found")
    out = rows.join(found, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), report
