"""Boosted trees for all classes at once, grown from grouped sums.

Features are binned once. A level of all trees of a round is one pass: per feature and bin
the sums of gradients and curvatures of every open node, which is a table of classes x nodes x
features x bins however many rows there are. Splits are found on that table. Missing values go to the side
where they gain more. Nothing runs in Python but the loop over rounds and levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import as_column, nan_to_null
from ..functions.numbers import let, soft_scores, top_class
from ..session import cut_lineage


@dataclass(frozen=True)
class Penalty:
    """``l1`` shrinks sums of gradients, ``l2`` is added to curvatures; a side needs ``curvature`` and a split ``gain``."""

    l1: float = 10.0
    l2: float = 1.0
    curvature: float = 1.0
    gain: float = 1e-6

    def shrunk(self, g: Column) -> Column:
        return F.signum(g) * F.greatest(F.abs(g) - self.l1, F.lit(0.0))

    def worth(self, g: Column, h: Column) -> Column:
        return F.pow(self.shrunk(g), 2) / (h + self.l2)

    def weight(self, g: float, h: float) -> float:
        return -math.copysign(max(abs(g) - self.l1, 0.0), g) / (h + self.l2)


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows below ``threshold`` go left; without one all that have a value do. Rows without a value follow ``missing_left``."""

    feature: int
    bin: int
    threshold: float | None
    missing_left: bool
    left: Split | Leaf
    right: Split | Leaf


Tree = Split | Leaf


def quantile_edges(df: DataFrame, features: Sequence[str], most_bins: int = 64) -> list[list[float]]:
    """Cut points per feature, taken from its own values at equal numbers of rows. A feature without values has none."""
    shares = [i / most_bins for i in range(1, most_bins)]
    found = df.approxQuantile(list(features), shares, 1 / (8 * most_bins))
    return [sorted(set(values)) for values in found]


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], name: str = "bins") -> DataFrame:
    """Adds an array with each feature's bin: 0 where it is missing, else 1 and one more for every edge that it reaches."""
    cut = [i for i, own in enumerate(edges) if own]
    values = {f"_value{i}": nan_to_null(as_column(f).cast("double")) for i, f in enumerate(features)}
    filled = {f"_filled{i}": F.coalesce(F.col(f"_value{i}"), F.lit(0.0)) for i in cut}
    placed = df.withColumns(values).withColumns(filled)
    if cut:
        placed = Bucketizer(
            splitsArray=[[-math.inf, *edges[i], math.inf] for i in cut],
            inputCols=[f"_filled{i}" for i in cut], outputCols=[f"_bin{i}" for i in cut],
        ).transform(placed)
    bins = [
        F.when(F.col(f"_value{i}").isNull(), 0).otherwise(F.col(f"_bin{i}").cast("int") + 1 if i in cut else F.lit(1))
        for i in range(len(features))
    ]
    return placed.withColumn(name, F.array(*bins)).drop(*values, *filled, *[f"_bin{i}" for i in cut])


def with_gradients(df: DataFrame, classes: int, label: str = "label", margins: str = "margins") -> DataFrame:
    """Adds ``g`` and ``h``: first and second derivative of the softmax loss by each class's margin."""
    scores = soft_scores(margins)
    own = as_column(label).cast("int")
    both = let(scores, lambda p: F.struct(
        F.transform(p, lambda x, i: x - (i == own).cast("double")).alias("g"),
        F.transform(p, lambda x: F.greatest(2.0 * x * (1.0 - x), F.lit(1e-16))).alias("h"),
    ))
    return df.withColumn("_both", both).withColumns({"g": F.col("_both.g"), "h": F.col("_both.h")}).drop("_both")


def level_sums(df: DataFrame, open_nodes: Sequence[tuple[int, int]], nodes: Sequence[Column] | None = None) -> DataFrame:
    """(class, node, feature, bin, g, h) over all rows of ``bins``, ``g`` and ``h``. ``open_nodes``: (class, node) pairs to sum
    for; ``nodes``: per class the node in which a row is, the root 0 where not given.

    One pass with partial sums: before the exchange a task holds at most a row per feature and bin."""
    place = F.array(*nodes) if nodes else None
    kept = df.select("bins", "g", "h", *([place.alias("_nodes")] if nodes else []))
    long = kept.select(F.posexplode("bins").alias("feature", "bin"), "g", "h", *(["_nodes"] if nodes else []))

    def own(of: str, k: int, node: int) -> Column:
        value = F.col(of)[k]
        return F.sum(F.when(F.col("_nodes")[k] == node, value) if nodes else value)

    sums = [own(of, k, node).alias(f"{of}{i}") for i, (k, node) in enumerate(open_nodes) for of in ("g", "h")]
    wide = long.groupBy("feature", "bin").agg(*sums)
    cells = [
        F.struct(F.lit(k).alias("class"), F.lit(node).alias("node"), F.col(f"g{i}").alias("g"), F.col(f"h{i}").alias("h"))
        for i, (k, node) in enumerate(open_nodes)
    ]
    return wide.select("feature", "bin", F.inline(F.array(*cells))).filter("h IS NOT NULL").select("class", "node", "feature", "bin", "g", "h")


def split_gains(sums: DataFrame, penalty: Penalty = Penalty()) -> DataFrame:
    """Every way to split a node: bins up to ``bin`` go left, missing values as ``missing_left`` says. ``gain`` is NULL where a side has too little
    curvature; ``g``, ``h`` are the node's sums, ``left_g``, ``left_h`` those of the left side. Windows hold the bins of one feature."""
    group = Window.partitionBy("class", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present = F.col("bin") > 0
    rows = sums.select(
        "class", "node", "feature", "bin",
        F.sum("g").over(group).alias("all_g"), F.sum("h").over(group).alias("all_h"),
        F.coalesce(F.sum(F.when(~present, F.col("g"))).over(group), F.lit(0.0)).alias("gone_g"),
        F.coalesce(F.sum(F.when(~present, F.col("h"))).over(group), F.lit(0.0)).alias("gone_h"),
        F.coalesce(F.sum(F.when(present, F.col("g"))).over(upto), F.lit(0.0)).alias("low_g"),
        F.coalesce(F.sum(F.when(present, F.col("h"))).over(upto), F.lit(0.0)).alias("low_h"),
    )
    sides = rows.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    left = {c: F.col(f"low_{c}") + F.when(F.col("missing_left"), F.col(f"gone_{c}")).otherwise(0.0) for c in ("g", "h")}
    placed = sides.select(
        "class", "node", "feature", "bin", "missing_left", F.col("all_g").alias("g"), F.col("all_h").alias("h"),
        left["g"].alias("left_g"), left["h"].alias("left_h"),
    )
    right_g, right_h = F.col("g") - F.col("left_g"), F.col("h") - F.col("left_h")
    enough = (F.col("bin") > 0) & (F.col("left_h") >= penalty.curvature) & (right_h >= penalty.curvature)
    gain = penalty.worth(F.col("left_g"), F.col("left_h")) + penalty.worth(right_g, right_h) - penalty.worth(F.col("g"), F.col("h"))
    return placed.withColumn("gain", F.when(enough, gain))


def best_splits(gains: DataFrame) -> DataFrame:
    """The best row of each node; equal gains (to 9 digits after the point) go to the first feature, the first bin, missing
    values right. A node that cannot be split has a row without gain."""
    order = [(-F.round(F.coalesce("gain", F.lit(-1.0)), 9)).alias("order"), "feature", "bin", "missing_left"]
    best = F.min(F.struct(*order, "gain", "g", "h", "left_g", "left_h")).alias("best")
    return gains.groupBy("class", "node").agg(best).select("class", "node", "best.*").drop("order")


def route(tree: Tree, left: callable, leaf: callable) -> Column:
    """A nested condition over a tree: ``left`` tells whether a row goes left, ``leaf`` what it gets."""
    if isinstance(tree, Leaf):
        return leaf(tree)
    return F.when(left(tree), route(tree.left, left, leaf)).otherwise(route(tree.right, left, leaf))


def left_by_bin(split: Split) -> Column:
    own = F.col("bins")[split.feature]
    return F.when(own == 0, F.lit(split.missing_left)).otherwise(own <= split.bin)


@dataclass(frozen=True)
class BoostedTrees:
    """One tree per round and class over raw feature columns."""

    features: tuple[str, ...]
    classes: int
    rounds: tuple[tuple[Tree, ...], ...]

    def _left(self, split: Split) -> Column:
        value = nan_to_null(as_column(self.features[split.feature]).cast("double"))
        below = F.lit(True) if split.threshold is None else value < split.threshold
        return F.when(value.isNull(), F.lit(split.missing_left)).otherwise(below)

    def contributions(self) -> Column:
        """What each round adds to the margins: an array by round of arrays by class."""
        return F.array(*[
            F.array(*[route(tree, self._left, lambda leaf: F.lit(leaf.value)) for tree in trees]) for trees in self.rounds
        ])

    def margins(self) -> Column:
        nothing = F.array_repeat(F.lit(0.0), self.classes)
        return F.aggregate(self.contributions(), nothing, lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y))

    def staged(self, df: DataFrame, label: str, *keys: str) -> DataFrame:
        """(keys, step, rows, loss, accuracy) after every round, from one pass: a row carries its margins from
        round to round and gives its loss at each."""
        own = as_column(label).cast("int")

        def judged(margins: Column) -> Column:
            score = let(margins, lambda m: F.element_at(soft_scores(m), own + 1))
            return F.struct((-F.ln(F.greatest(score, F.lit(1e-15)))).alias("loss"), (top_class(margins) == own).alias("right"))

        zeros = F.array_repeat(F.lit(0.0), self.classes)
        start = F.struct(zeros.alias("m"), F.array(judged(zeros)).alias("out"))

        def step(acc: Column, c: Column) -> Column:
            return let(F.zip_with(acc["m"], c, lambda x, y: x + y),
                       lambda m: F.struct(m.alias("m"), F.array_append(acc["out"], judged(m)).alias("out")))

        per_row = df.select(*keys, F.aggregate(self.contributions(), start, step)["out"].alias("out"))
        long = per_row.select(*keys, F.posexplode("out").alias("step", "at"))
        return long.groupBy(*keys, "step").agg(
            F.count(F.lit(1)).alias("rows"), F.avg("at.loss").alias("loss"), F.avg(F.col("at.right").cast("double")).alias("accuracy")
        )


def grow(state: DataFrame, classes: int, depth: int, rate: float, penalty: Penalty, edges: Sequence[Sequence[float]]) -> tuple[Tree, ...]:
    """One tree per class, a pass over ``state`` (bins, g, h) for each level."""
    found: dict[tuple[int, int, int], object] = {}
    trees: list[Tree] = []

    def built(k: int, level: int, node: int, g: float, h: float) -> Tree:
        row = found.get((k, level, node))
        if row is None or row["gain"] is None or row["gain"] <= penalty.gain:
            return Leaf(rate * penalty.weight(g, h))
        own = edges[row["feature"]]
        threshold = own[row["bin"] - 1] if row["bin"] <= len(own) else None
        left = built(k, level + 1, 2 * node, row["left_g"], row["left_h"])
        right = built(k, level + 1, 2 * node + 1, row["g"] - row["left_g"], row["h"] - row["left_h"])
        return Split(row["feature"], row["bin"], threshold, row["missing_left"], left, right)

    def places(tree: Tree, level: int, node: int = 0) -> Column:
        """The node of ``level`` in which a row is; -1 where its branch ended above."""
        if isinstance(tree, Leaf):
            return F.lit(-1 if level else node)
        return F.when(left_by_bin(tree), places(tree.left, level - 1, 2 * node)).otherwise(places(tree.right, level - 1, 2 * node + 1))

    open_nodes = [(k, 0) for k in range(classes)]
    for level in range(depth):
        nodes = [places(t, level) for t in trees] if level else None
        rows = best_splits(split_gains(level_sums(state, open_nodes, nodes), penalty)).collect()
        found.update({(r["class"], level, r["node"]): r for r in rows})
        trees = [
            built(k, 0, 0, found[k, 0, 0]["g"], found[k, 0, 0]["h"]) if (k, 0, 0) in found else Leaf(0.0) for k in range(classes)
        ]
        open_nodes = [
            (r["class"], 2 * r["node"] + side) for r in rows if r["gain"] is not None and r["gain"] > penalty.gain for side in (0, 1)
        ]
        if not open_nodes:
            break
    return tuple(trees)


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    depth: int = 2,
    rounds: int = 10,
    rate: float = 0.1,
    penalty: Penalty = Penalty(),
    classes: int | None = None,
    most_bins: int = 64,
    cut_every: int = 5,
) -> BoostedTrees:
    """One softmax ensemble over classes from 0. ``classes`` is one more than the largest label where not given.

    A round makes ``depth`` passes over bins and margins only. What reaches the driver is a row per node. The passes
    carry the trees since margins were last written, every ``cut_every`` rounds. Rows without label teach nothing; a table without
    rows gives trees of leaves at 0."""
    columns = [nan_to_null(as_column(f).cast("double")).alias(f"_f{i}") for i, f in enumerate(features)]
    rows = train.select(*columns, as_column(label).cast("int").alias("label")).filter("label IS NOT NULL")
    names = [f"_f{i}" for i in range(len(features))]
    edges = quantile_edges(rows, names, most_bins)
    slim = cut_lineage(binned(rows, names, edges).select("label", "bins"))
    if classes is None:
        classes = (slim.agg(F.max("label")).first()[0] or 0) + 1
    state = slim.withColumn("margins", F.array_repeat(F.lit(0.0), classes))
    grown: list[tuple[Tree, ...]] = []
    for number in range(1, rounds + 1):
        trees = grow(with_gradients(state, classes), classes, depth, rate, penalty, edges)
        grown.append(trees)
        added = F.array(*[route(t, left_by_bin, lambda leaf: F.lit(leaf.value)) for t in trees])
        state = state.withColumn("margins", F.zip_with("margins", added, lambda x, y: x + y))
        if number % cut_every == 0 and number < rounds:
            state = cut_lineage(state)
    return BoostedTrees(tuple(features), classes, tuple(grown))
