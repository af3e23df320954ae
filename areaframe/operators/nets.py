"""A net with one hidden layer of rectified units, fitted by full-batch descent with weight decay.

Training rows are packed once into blocks of numbers, which the executors keep. A step is one pass over them: every task works
out the gradient of its blocks as products of matrices and hands on one array, the sum. Rows stay where they are. What reaches the
driver are these sums, a number per weight, from a few tasks per core at most; they are added up in the order of the tasks.
:meth:`ReluNet.gradients` says the same of a single row, as an expression.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_column, nan_to_null
from ..functions.numbers import let, soft_scores, top_class
from ..session import cut_lineage

Matrix = tuple[tuple[float, ...], ...]


def constants(matrix: Sequence[Sequence[float]]) -> Column:
    """One constant, however many weights it has: the optimiser reads it once."""
    return F.from_json(F.lit(json.dumps([list(row) for row in matrix])), "array<array<double>>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def outer(a: Column, b: Column) -> Column:
    """All products, by ``a`` and then by ``b``, in one array."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


@dataclass(frozen=True)
class ReluNet:
    """``hidden`` and ``output``: a row of weights per unit, its bias last. ``trace``: rows, loss and accuracy before
    each step and after the last."""

    features: tuple[str, ...]
    hidden: Matrix
    output: Matrix
    trace: tuple[tuple[int, float, float], ...] = ()

    def inputs(self) -> Column:
        return F.array(*[nan_to_null(as_column(f).cast("double")) for f in self.features], F.lit(1.0))

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows that have every feature."""
        present = F.lit(True)
        for f in self.features:
            present = present & nan_to_null(as_column(f).cast("double")).isNotNull()
        return df.filter(present)

    def activations(self, x: Column) -> Column:
        """The hidden units, and 1 for the bias."""
        units = F.transform(constants(self.hidden), lambda w: F.greatest(dot(w, x), F.lit(0.0)))
        return F.concat(units, F.array(F.lit(1.0)))

    def outputs(self, a: Column) -> Column:
        return F.transform(constants(self.output), lambda w: dot(w, a))

    def margins(self, x: Column | None = None) -> Column:
        return let(self.inputs() if x is None else x, lambda v: let(self.activations(v), self.outputs))

    def gradients(self, x: Column, label: Column) -> Column:
        """Of one row: 1, its loss, whether it is right, then the loss's derivative by each weight, hidden ones first."""
        into = constants(list(zip(*self.output))[:-1])  # per hidden unit its weights to the classes

        def backward(a: Column, scores: Column, delta: Column) -> Column:
            loss = -F.ln(F.greatest(F.element_at(scores, label + 1), F.lit(1e-300)))
            right = (top_class(scores) == label).cast("double")
            reached = F.zip_with(F.transform(into, lambda w: dot(w, delta)), a, lambda d, unit: F.when(unit > 0, d).otherwise(0.0))
            # The bias's 1 has no weight into it: it is longer by one, and that entry goes.
            own = F.slice(reached, 1, len(self.hidden))
            return F.concat(F.array(F.lit(1.0), loss, right), outer(own, x), outer(delta, a))

        def forward(a: Column) -> Column:
            return let(soft_scores(self.outputs(a)), lambda p: let(
                F.transform(p, lambda v, i: v - (i == label).cast("double")), lambda d: backward(a, p, d)))

        return let(self.activations(x), forward)


def first_weights(rows: int, inputs: int, rng: random.Random) -> Matrix:
    """Even between -1 and 1 over the root of the number of inputs, the bias too."""
    reach = 1 / math.sqrt(inputs)
    return tuple(tuple(rng.uniform(-reach, reach) for _ in range(inputs + 1)) for _ in range(rows))


def start_net(features: Sequence[str], classes: int, hidden: int = 20, seed: int = 0) -> ReluNet:
    rng = random.Random(seed)
    width = len(features)
    return ReluNet(tuple(features), first_weights(hidden, width, rng), first_weights(classes, hidden, rng))


def gradient_sums(net: ReluNet, rows: DataFrame, x: str = "x", label: str = "label") -> DataFrame:
    """One row with ``total``, the sum of :meth:`ReluNet.gradients` over all rows, of which there must be some."""
    own = net.gradients(as_column(x), as_column(label).cast("int"))
    vectors = rows.select(array_to_vector(own).alias("v"))
    return vectors.select(Summarizer.sum(F.col("v")).alias("v")).select(vector_to_array("v").alias("total"))


#: Rows in a block; a task gets one block's rows at least, where there are as many.
BLOCK_ROWS = 4096
#: Tasks of a step for each core at most, so that the sums the driver adds up follow the cluster and not the rows.
TASKS_PER_CORE = 4


def packed(most: int):
    """A task's batches of ``x`` and ``label`` as blocks: the bytes of a matrix, a row for each row and its label last."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                some = batch.slice(start, most)
                x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                block = np.column_stack([x, some.column(1).to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    return task


def blocks_of(rows: DataFrame) -> RDD:
    """``x`` and ``label``, in which nothing is missing, as bytes of blocks, kept by the executors: each step reads them as they
    are. What an executor loses is packed again from ``rows``."""
    blocks = rows.select("x", F.col("label").cast("int").alias("label")).mapInArrow(packed(BLOCK_ROWS), "block binary")
    most = min(-(-rows.count() // BLOCK_ROWS), TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return blocks.rdd.map(lambda row: bytes(row[0])).coalesce(max(1, most)).persist(StorageLevel.MEMORY_AND_DISK)


def summed_blocks(net: ReluNet):
    """Of a task's blocks: one array, the sum of :meth:`ReluNet.gradients`; none where there are no rows."""
    hidden, output = np.array(net.hidden), np.array(net.output)
    width = hidden.shape[1]

    def task(blocks: Iterator[bytes]) -> Iterator[np.ndarray]:
        total = None
        for block in blocks:
            both = np.frombuffer(block).reshape(-1, width + 1)
            x = both[:, :-1]
            at = np.arange(len(x)), both[:, -1].astype(np.int64)
            units = np.maximum(x @ hidden.T, 0.0)
            a = np.hstack([units, np.ones((len(x), 1))])
            powers = a @ output.T
            powers = np.exp(powers - powers.max(axis=1, keepdims=True))
            scores = powers / powers.sum(axis=1, keepdims=True)
            own = scores[at]
            # The first of the largest, as top_class.
            right = scores.argmax(axis=1) == at[1]
            delta = scores.copy()
            delta[at] -= 1.0
            # NaN counts as above 0, as in an expression.
            reached = np.where(units <= 0.0, 0.0, delta @ output[:, :-1])
            loss = -np.log(np.maximum(own, 1e-300))
            sums = np.concatenate([[len(x), loss.sum(), right.sum()], (reached.T @ x).ravel(), (delta.T @ a).ravel()])
            total = sums if total is None else total + sums
        if total is not None:
            yield total

    return task


def block_gradient(net: ReluNet, blocks: RDD) -> list[float]:
    """The ``total`` of :func:`gradient_sums` over the rows in ``blocks``."""
    return sum(blocks.mapPartitions(summed_blocks(net)).collect()).tolist()


def batch_gradient(net: ReluNet, rows: DataFrame) -> list[float]:
    """The ``total`` of :func:`gradient_sums` over ``x`` and ``label``, in which nothing is missing."""
    blocks = blocks_of(rows)
    total = block_gradient(net, blocks)
    blocks.unpersist()
    return total


def stepped(net: ReluNet, total: Sequence[float], rate: float, decay: float) -> ReluNet:
    """A step down the mean gradient; ``decay`` draws every weight, biases too, towards 0."""
    n, flat = total[0], iter(total[3:])

    def moved(matrix: Matrix) -> Matrix:
        return tuple(tuple(w - rate * (next(flat) / n + decay * w) for w in row) for row in matrix)

    hidden = moved(net.hidden)
    return ReluNet(net.features, hidden, moved(net.output), (*net.trace, (int(n), total[1] / n, total[2] / n)))


def fit_relu_net(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    classes: int,
    hidden: int = 20,
    steps: int = 1000,
    rate: float = 0.1,
    decay: float = 1e-4,
    seed: int = 0,
) -> ReluNet:
    """One pass over the complete training rows for each step, and one more for the last loss. Rows without label teach
    nothing; without rows the first weights stay and the trace is empty. A label beyond ``classes`` stops the job."""
    net = start_net(features, classes, hidden, seed)
    own = as_column(label).cast("int")
    known = F.when(own.between(0, classes - 1), own).otherwise(F.raise_error(F.lit("a label lies outside the classes")))
    labelled = net.complete(train).filter(own.isNotNull())
    rows = cut_lineage(labelled.select(net.inputs().alias("x"), known.alias("label")))
    if rows.isEmpty():
        return net
    blocks = blocks_of(rows)
    for _ in range(steps):
        net = stepped(net, block_gradient(net, blocks), rate, decay)
    # What the last step led to, seen by one pass more; its gradient is not followed.
    seen = stepped(net, block_gradient(net, blocks), 0.0, 0.0)
    blocks.unpersist()
    return ReluNet(net.features, net.hidden, net.output, seen.trace)
