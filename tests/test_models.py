"""Both classifiers end to end on a table they can learn, and step by step against plain ones."""

import inspect
import math
import random

import pytest
from pyspark.sql import functions as F

from areaframe.operators import nets
from areaframe.operators.boosting import (
    BoostedTrees,
    Leaf,
    Penalty,
    Split,
    best_splits,
    binned,
    level_sums,
    quantile_edges,
    split_gains,
    with_gradients,
)
from areaframe.operators.features import split_order, stratified_split
from areaframe.operators.metrics import log_loss_of
from areaframe.operators.models import fit_boosted_trees, fit_relu_net, predict, training_trace
from areaframe.operators.nets import ReluNet, batch_gradient, gradient_sums, start_net, stepped
from areaframe.plans import prepare_features, train_and_evaluate
from areaframe.queries import jobs, scoring


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(3)
    data = []
    for i in range(300):
        hvi = i % 3 + 1
        data.append((
            i, hvi * 10 + rng.gauss(0, 1), None if i in (7, 50) else rng.random() - hvi, hvi, hvi
        ))
    schema = "zipcode int, income double, share double, most_common_landuse_code int, hvi int"
    return spark.createDataFrame(data, schema)


def test_train_and_evaluate(features):
    got = train_and_evaluate(features, classes=(0, 1, 2), rounds=3, steps=25)
    listed = got.collect()
    measured = [r for r in listed if r["step"] is None]
    table = {(r["model"], r["metric"], r["class"]): r["value"] for r in measured if r["predicted"] is None}
    trace = {(r["model"], r["metric"], r["part"], r["step"]): r["value"] for r in listed if r["step"] is not None}
    for model in ("boosted_trees", "neural_net"):
        assert {k[1:] for k in table if k[0] == model} == {
            ("accuracy", None), ("train_accuracy", None), ("train_log_loss", None),
            ("macro_auc", None), ("auc", 0), ("auc", 1), ("auc", 2), ("rows", None), ("train_rows", None),
        }
        matrix = {
            (r["class"], r["predicted"]): r["value"]
            for r in listed if r["model"] == model and r["metric"] == "confusion"
        }
        assert set(matrix) == {(a, b) for a in range(3) for b in range(3)}
        held_out = table[model, "rows", None]
        assert sum(matrix.values()) == held_out
        assert sum(matrix[c, c] for c in range(3)) / held_out == pytest.approx(table[model, "accuracy", None])
        assert table[model, "accuracy", None] > 0.9
        assert table[model, "macro_auc", None] > 0.95
        mean = sum(table[model, "auc", c] for c in range(3)) / 3
        assert table[model, "macro_auc", None] == pytest.approx(mean)
        # The trace ends at the measures of the finished model.
        steps = sorted(k[3] for k in trace if k[:3] == (model, "trace_loss", "train"))
        assert steps == list(range((3 if model == "boosted_trees" else 25) + 1))
        assert trace[model, "trace_loss", "train", steps[-1]] == pytest.approx(table[model, "train_log_loss", None])
        assert trace[model, "trace_accuracy", "train", steps[-1]] == pytest.approx(table[model, "train_accuracy", None])
    losses = [trace["boosted_trees", "trace_loss", "train", i] for i in range(4)]
    assert losses[0] == pytest.approx(math.log(3)) and losses == sorted(losses, reverse=True)
    assert ("boosted_trees", "trace_loss", "validation", 3) in trace


# Trees


def plain_boosting(rows, classes, edges, depth, rounds, rate, penalty):
    """Softmax boosting over binned rows: [(values, label)]; returns margins per row."""

    def bin_of(value, own):
        return 0 if value is None else 1 + sum(value >= e for e in own)

    placed = [([bin_of(v, e) for v, e in zip(values, edges)], label) for values, label in rows]
    margins = [[0.0] * classes for _ in rows]

    def shrunk(g):
        return math.copysign(max(abs(g) - penalty.l1, 0), g)

    def worth(g, h):
        return shrunk(g) ** 2 / (h + penalty.l2)

    def grow(of, g, h, left):
        total_g, total_h = sum(g[i] for i in of), sum(h[i] for i in of)
        best = None
        for f in range(len(edges)) if left else ():
            for b in sorted({placed[i][0][f] for i in of} - {0}):
                for missing_left in (False, True):
                    side = [i for i in of if (missing_left if placed[i][0][f] == 0 else placed[i][0][f] <= b)]
                    lg, lh = sum(g[i] for i in side), sum(h[i] for i in side)
                    if lh < penalty.curvature or total_h - lh < penalty.curvature:
                        continue
                    gain = worth(lg, lh) + worth(total_g - lg, total_h - lh) - worth(total_g, total_h)
                    key = (-round(gain, 9), f, b, missing_left)
                    if gain > penalty.gain and (best is None or key < best[0]):
                        best = key, side
        if best is None:
            return [(of, -rate * shrunk(total_g) / (total_h + penalty.l2))]
        rest = sorted(set(of) - set(best[1]))
        return grow(best[1], g, h, left - 1) + grow(rest, g, h, left - 1)

    for _ in range(rounds):
        scores = []
        for m in margins:
            powers = [math.exp(x - max(m)) for x in m]
            scores.append([p / sum(powers) for p in powers])
        for k in range(classes):
            g = [p[k] - (label == k) for p, (_, label) in zip(scores, placed)]
            h = [max(2 * p[k] * (1 - p[k]), 1e-16) for p in scores]
            for of, value in grow(list(range(len(rows))), g, h, depth):
                for i in of:
                    margins[i][k] += value
    return margins


@pytest.mark.parametrize("depth, penalty", [(2, Penalty(l1=1.0)), (3, Penalty(l1=0.0, curvature=0.5)), (2, Penalty())])
def test_trees_equal_plain_boosting(spark, depth, penalty):
    rng = random.Random(depth)
    rows = []
    for i in range(200):
        label = rng.choice([0, 1, 1, 2])
        values = (
            None if rng.random() < 0.2 * (label + 1) else float(rng.randint(0, 6) + 2 * label),
            round(rng.gauss(label, 1.5), 2), None if label == 2 and i % 2 else 1.0, 5.0,
        )
        rows.append((values, label))
    frame = spark.createDataFrame([(i, *v, y) for i, (v, y) in enumerate(rows)], "id int, a double, b double, c double, d double, y int")
    names = ["a", "b", "c", "d"]
    model = fit_boosted_trees(frame.repartition(3), names, "y", depth=depth, rounds=3, rate=0.3, penalty=penalty, cut_every=2)
    edges = quantile_edges(frame, names)
    expected = plain_boosting(rows, 3, edges, depth, 3, 0.3, penalty)
    got = {r["id"]: r["m"] for r in frame.select("id", model.margins().alias("m")).collect()}
    for i, margins in enumerate(expected):
        assert got[i] == pytest.approx(margins, abs=1e-9)
    losses = [r["loss"] for r in model.staged(frame.withColumn("p", F.lit("all")), "y", "p").orderBy("step").collect()]
    assert len(losses) == 4 and losses == sorted(losses, reverse=True)
    assert "EvalPython" not in predict(model, frame, "y")._jdf.queryExecution().executedPlan().toString()


def test_bins_edges_and_missing(spark):
    frame = spark.createDataFrame(
        [(1.0, None), (2.0, float("nan")), (None, None), (float("inf"), None), (float("-inf"), None)], "a double, b double"
    )
    got = [tuple(r["bins"]) for r in binned(frame, ["a", "b"], [[1.0, 2.0], []]).collect()]
    assert got == [(2, 0), (3, 0), (0, 0), (3, 0), (1, 0)]
    assert quantile_edges(frame, ["b"]) == [[]]


def test_a_node_that_cannot_be_split_has_no_gain(spark):
    frame = spark.createDataFrame([(0, [1, 0]), (1, [1, 0]), (1, [1, 0])], "label int, bins array<int>")
    state = with_gradients(frame.withColumn("margins", F.array(F.lit(0.0), F.lit(0.0))), 2)
    rows = best_splits(split_gains(level_sums(state, [(0, 0), (1, 0)]))).collect()
    assert [(r["class"], r["node"], r["gain"]) for r in sorted(rows)] == [(0, 0, None), (1, 0, None)]


def test_trees_without_rows_and_with_unknown_labels(spark):
    empty = spark.createDataFrame([], "a double, y int")
    model = fit_boosted_trees(empty, ["a"], "y", rounds=2, classes=2)
    assert model.rounds == ((Leaf(0.0), Leaf(0.0)),) * 2
    some = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, None)] * 40, "a double, y int")
    known = fit_boosted_trees(some.filter("y IS NOT NULL"), ["a"], "y", rounds=1)
    assert fit_boosted_trees(some, ["a"], "y", rounds=1) == known and isinstance(known.rounds[0][0], Split)


def test_a_class_without_training_rows_scores_zero(features):
    rows = features.withColumn("hvi", F.col("hvi") - 1).filter("share IS NOT NULL")
    for model in (
        fit_boosted_trees(rows.filter("hvi < 2"), ["income", "share"], "hvi", rounds=2),
        fit_relu_net(rows.filter("hvi < 2"), ["income", "share"], "hvi", 2, steps=2),
    ):
        scored = predict(model, rows, "hvi", classes=3)
        assert scored.filter("size(scores) != 3 OR scores[2] != 0").isEmpty()
        assert scored.filter("hvi = 2").agg(log_loss_of("label", "scores")).first()[0] > 10


# Net


def plain_loss(net, rows):
    total = 0.0
    for x, label in rows:
        a = [max(0.0, sum(w * v for w, v in zip(row, [*x, 1]))) for row in net.hidden]
        z = [sum(w * v for w, v in zip(row, [*a, 1])) for row in net.output]
        total += math.log(sum(math.exp(v - max(z)) for v in z)) + max(z) - z[label]
    return total


def test_gradient_equals_differences(spark):
    rng = random.Random(5)
    rows = [([rng.gauss(0, 1), rng.gauss(0, 1)], rng.randint(0, 2)) for _ in range(40)]
    net = start_net(["a", "b"], 3, hidden=4, seed=2)
    frame = spark.createDataFrame([(*x, y) for x, y in rows], "a double, b double, label int")
    total = batch_gradient(net, frame.repartition(3).select(net.inputs().alias("x"), "label"))
    assert total[0] == 40 and total[1] == pytest.approx(plain_loss(net, rows))
    flat = [w for matrix in (net.hidden, net.output) for row in matrix for w in row]

    def moved(at, by):
        weights = iter([w + by * (i == at) for i, w in enumerate(flat)])
        hidden, output = (tuple(tuple(next(weights) for _ in row) for row in m) for m in (net.hidden, net.output))
        return ReluNet(net.features, hidden, output)

    for i, mine in enumerate(total[3:]):
        assert mine == pytest.approx((plain_loss(moved(i, 1e-5), rows) - plain_loss(moved(i, -1e-5), rows)) / 2e-5, abs=1e-4)
    # Weight decay alone shrinks every weight, biases too.
    still = stepped(net, [40.0, 1.0, 1.0, *[0.0] * len(flat)], rate=0.5, decay=0.1)
    assert [w for m in (still.hidden, still.output) for row in m for w in row] == pytest.approx([0.95 * w for w in flat])


def test_descent_lowers_the_loss_and_skips_missing(features):
    train = features.withColumn("hvi", F.col("hvi") - 1)
    model = fit_relu_net(train, ["share"], "hvi", 3, steps=25, seed=1)
    trace = training_trace(model, train, "hvi").orderBy("step").collect()
    assert len(trace) == 26 and {r["rows"] for r in trace} == {298}
    assert trace[-1]["loss"] < trace[0]["loss"]
    scored = predict(model, train, "hvi")
    assert scored.count() == 298
    assert abs(scored.select(F.expr("aggregate(scores, 0D, (a, x) -> a + x)")).first()[0] - 1) < 1e-9
    assert "EvalPython" not in scored._jdf.queryExecution().executedPlan().toString()
    assert fit_relu_net(train.limit(0), ["share"], "hvi", 3, steps=3, seed=1) == start_net(["share"], 3, seed=1)


def test_prepared_table(features):
    prepared = prepare_features(features, classes=(0, 1, 2))
    assert prepared.columns == [*features.columns, "split"]
    train = prepared.filter(F.col("split") == "train")
    assert abs(train.agg(F.avg("income")).first()[0]) < 1e-9
    assert prepared.select("most_common_landuse_code").distinct().count() == 3
    assert {r[0] for r in prepared.select("hvi").distinct().collect()} == {0, 1, 2}


def test_an_id_on_both_sides_of_a_cut_stops_the_split(spark):
    frame = spark.createDataFrame([(i // 50, 0) for i in range(100)], "id int, y int")
    with pytest.raises(Exception, match="both sides of a cut"):
        stratified_split(frame, "id", "y", [0], 1).collect()
    again = spark.createDataFrame([(i, 0) for i in range(40)], "id int, y int")
    parts = stratified_split(again.union(again.filter("id = 3")), "id", "y", [0], 1)
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes == {"test": 5, "validation": 4, "train": 32}
    assert again.select(split_order("id", 1)).distinct().count() == 40


def test_repeated_ids_are_split_to_exact_sizes_when_told(spark):
    """Ids on the cuts, equal rows, missing ids, and one id that holds both cuts."""
    for listed in (
        [(i // 50, i % 3, 0) for i in range(100)],
        [(7, None, 0)] * 40,
        [(None, i % 2, 0) for i in range(30)] + [(i % 4, 1, 0) for i in range(70)] + [(1, 1, 1)] * 20,
    ):
        frame = spark.createDataFrame(listed, "id int, x int, y int")
        parts = stratified_split(frame.repartition(3), "id", "y", [0, 1], 1, repeats=True).collect()
        assert sorted(str(r[:3]) for r in parts) == sorted(str(r) for r in listed)
        sizes = {s: sum(r["split"] == s for r in parts) for s in ("test", "validation", "train")}
        n = len(listed)
        test = math.ceil(n * 0.1)
        assert (sizes["test"], sizes["validation"]) == (test, math.ceil((n - test) * 0.1))
        again = stratified_split(frame.repartition(5), "id", "y", [0, 1], 1, repeats=True).collect()
        assert sorted(map(str, again)) == sorted(map(str, parts))
    alone = spark.createDataFrame([(i, i % 5, 0) for i in range(100)], "id int, x int, y int")
    plain, told = (stratified_split(alone, "id", "y", [0], 1, repeats=r).collect() for r in (False, True))
    assert sorted(plain) == sorted(told)


def test_areas_that_come_more_than_once_are_prepared_and_judged(spark, features):
    """Keys cut to a fixed length repeat in a large spine."""
    twice = features.withColumn("zipcode", F.floor(F.col("zipcode") / 60).cast("int"))
    prepared = prepare_features(twice, classes=(0, 1, 2))
    assert {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()} == {"test": 30, "validation": 27, "train": 243}
    judged = train_and_evaluate(twice, classes=(0, 1, 2), rounds=1, steps=1).filter("metric = 'rows' AND model = 'boosted_trees'")
    assert [r["value"] for r in judged.collect()] == [27]


def test_batches_give_the_sums_of_single_rows_and_leave_the_expressions(spark, monkeypatch):
    rng = random.Random(9)
    listed = [([rng.gauss(0, 1), rng.gauss(0, 3), 1.0], rng.randint(0, 2)) for _ in range(500)] + [([1e4, -1e4, 1.0], 1)]
    net = start_net(["a", "b"], 3, hidden=5, seed=4)
    frame = spark.createDataFrame(listed, "x array<double>, label int").repartition(6)
    assert batch_gradient(net, frame) == pytest.approx(list(gradient_sums(net, frame).first()["total"]), rel=1e-9, abs=1e-9)
    odd = spark.createDataFrame([([float("inf"), 1.0, 1.0], 0)], "x array<double>, label int")
    assert [math.isnan(v) for v in batch_gradient(net, odd)] == [math.isnan(v) for v in gradient_sums(net, odd).first()["total"]]
    # A step of the fit works out no row by itself.
    monkeypatch.setattr(ReluNet, "gradients", None)
    train = frame.selectExpr("x[0] AS a", "x[1] AS b", "label")
    assert len(fit_relu_net(train, ["a", "b"], "label", 3, hidden=5, steps=2).trace) == 3


def test_row_counts_of_many_tasks_are_exact(spark):
    """A sum taken as a mean times a count came out as 297.99... and was cut to 297."""
    net = start_net(["a"], 2, hidden=2, seed=1)
    for n in range(290, 300):
        rows = spark.range(n).selectExpr("array(double(id), 1D) AS x", "int(id % 2) AS label").repartition(7)
        assert batch_gradient(net, rows)[0] == n


def test_blocks_are_cut_and_dealt_to_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(nets, "BLOCK_ROWS", 10)
    rows = spark.range(95).selectExpr("array(double(id), 1D) AS x", "int(id % 2) AS label").repartition(6)
    net = start_net(["a"], 2, hidden=2, seed=1)
    blocks = nets.blocks_of(rows)
    sizes = [len(b) // 24 for b in blocks.collect()]
    assert sum(sizes) == 95 and max(sizes) <= 10 and blocks.getNumPartitions() <= 6
    assert nets.block_gradient(net, blocks) == pytest.approx(list(gradient_sums(net, rows).first()["total"]), rel=1e-9)
    blocks.unpersist()
    monkeypatch.setattr(nets, "BLOCK_ROWS", 4096)
    assert nets.blocks_of(rows).getNumPartitions() == 1


def test_the_registered_net_takes_every_step_of_the_job(spark, tiny, monkeypatch):
    fitted = []

    def kept(*args, **named):
        fitted.append(fit_relu_net(*args, **named))
        return fitted[-1]

    monkeypatch.setattr(scoring, "fit_relu_net", kept)
    scored = scoring.neural_net_rows(spark, tiny).collect()
    assert len(scored) == 45 and [len(net.trace) for net in fitted] == [1001]
    assert fitted[0].trace[-1][1] < fitted[0].trace[20][1]


def test_the_registered_evaluation_trains_for_every_step_of_the_job(spark, tiny, monkeypatch):
    asked = []
    own = inspect.signature(train_and_evaluate)
    monkeypatch.setattr(jobs, "train_and_evaluate", lambda *args, **named: asked.append(own.bind(*args, **named)))
    jobs.train_evaluate(spark, tiny)
    asked[0].apply_defaults()
    assert (asked[0].arguments["rounds"], asked[0].arguments["steps"]) == (10, 1000)
