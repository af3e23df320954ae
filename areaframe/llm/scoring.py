"""LM scoring: a gated recurrent language model with a class-factored output softmax.

Word counts over all training documents make the vocabulary. The most frequent words, a
fixed number, travel to every task; the commonest of them have weights of their own, the
others share a class by frequency and by the group of documents they come from, with
probabilities by their counts. All remaining words are one class, whose members' counts
are joined in. Every partition trains on all its documents by truncated backpropagation,
and the partitions' parameters are averaged in a tree, twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gatednet import Net, Shape, Tokens, Trainer
from .shared import pieces, save
from .words import Hasher, word_spans

#: Stands for the end of a text among word hashes.
END = 1
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Vocabulary:
    """``listed`` words by hash. ``counts`` + 1 over ``n`` + ``v`` + 1 is the base; ``static`` is the natural
    log of a word's share in its class where the class has no weights."""

    hashes: np.ndarray
    inputs: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    static: np.ndarray
    logs: np.ndarray
    shape: Shape
    rare_total: float
    class_share: np.ndarray
    word_share: np.ndarray
    n: int
    v: int

    @property
    def rare(self) -> tuple[int, int]:
        return self.shape.inputs - 1, self.shape.classes - 1

    @classmethod
    def of(cls, top: pd.DataFrame, n: int, v: int, learnt: int, per_class: int, hidden: int) -> Vocabulary:
        """``top``: word, n, kin in order of frequency; ``n``, ``v``: tokens and words in all."""
        count = top["n"].to_numpy(np.float64)
        kin = top["kin"].to_numpy(np.int64)
        size = len(top)
        heads = min(learnt, size)
        n_heads = -(-heads // per_class)
        inputs, classes = np.empty(size, np.int64), np.empty(size, np.int64)
        words = np.full(size, -1, np.int64)
        # The commonest: by kin, then frequency, so that a class is much of one kind.
        order = np.lexsort((-count[:heads], kin[:heads]))
        inputs[:heads] = np.arange(heads)
        classes[order] = np.arange(heads) // per_class
        words[order] = np.arange(heads) % per_class
        # The others: classes of one kin, cut in two at equal numbers of tokens.
        rest = np.arange(heads, size)
        half = np.cumsum(count[rest]) > count[rest].sum() / 2
        kinds, which = np.unique(kin[rest] * 2 + half, return_inverse=True)
        classes[rest], inputs[rest] = n_heads + which, heads + which
        shape = Shape(heads + len(kinds) + 1, n_heads + len(kinds) + 1, n_heads, per_class, hidden)
        totals = np.bincount(classes, count + 1, shape.classes)
        static = np.where(words < 0, np.log((count + 1) / totals[classes]), 0.0)
        rare_n, rare_v = n - count.sum(), v - size
        totals[-1] = max(1, rare_n + rare_v + 1)
        inner = np.full((n_heads, per_class), 1e-9)
        inner[classes[:heads], words[:heads]] = count[:heads] + 1
        by = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
        return cls(
            top["word"].to_numpy(np.int64).view(np.uint64)[by], inputs[by].astype(np.int16), classes[by].astype(np.int16),
            words[by].astype(np.int16), static[by], np.log10(count + 1)[by], shape, float(totals[-1]), totals / totals.sum(), inner, n, v,
        )

    def first(self) -> dict[str, np.ndarray]:
        """Parameters that give the counts' own probabilities."""
        p = self.shape.empty()
        p["bc"] = np.log(self.class_share).astype(np.float32)
        p["bw"] = np.log(self.word_share).astype(np.float32)
        return p

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def tokens(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
        at, hit = self.find(hashes)
        rare_input, rare_class = self.rare
        return (
            Tokens(
                np.where(hit, self.inputs[at], np.int16(rare_input)), np.where(hit, self.classes[at], np.int16(rare_class)),
                np.where(hit, self.words[at], np.int16(-1)), bounds,
            ), at, hit,
        )


def word_hashes(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z as a-z, each text closed by its end; and their bounds."""
    starts, ends, bounds = word_spans(data, marks)
    words = Hasher(data, lower=True)(starts, ends)
    n = len(marks) - 1
    closed = np.arange(1, n + 1) + bounds[1:]
    out = np.full(len(words) + n, END, np.uint64)
    mask = np.ones(len(out), bool)
    mask[closed - 1] = False
    out[mask] = words
    return out, np.r_[0, closed]


KINS = 8


def word_counts(train: DataFrame, text: str, kin: str) -> DataFrame:
    """(word, n, kin) over all rows: counted per run of texts first, then per partition, then in all.
    ``kin``: the bucket of documents in which most of the word stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, text, 1 << 21):
            hashes, bounds = word_hashes(data, marks)
            kins = np.repeat(rows.column(rows.schema.get_field_index(kin)).to_numpy(zero_copy_only=False), np.diff(bounds))
            for k in np.unique(kins).tolist():
                words, n = np.unique(hashes[kins == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(n), pa.array(np.full(len(n), k, np.int32))], names=["word", "n", "kin"]
                )

    long = train.select(text, kin).mapInArrow(task, "word bigint, n bigint, kin int")
    by_kin = [F.sum(F.when(F.col("kin") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in range(KINS)]
    wide = long.groupBy("word").agg(F.sum("n").alias("n"), *by_kin)
    most = F.greatest(*[F.col(f"_{k}") for k in range(KINS)])
    first = F.coalesce(*[F.when(F.col(f"_{k}") == most, k) for k in range(KINS)])
    return wide.select("word", "n", first.alias("kin"))


def _train(vocabulary: Vocabulary, packed: bytes, text: str, rate: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(Net(vocabulary.shape, vocabulary.shape.unpack(packed)), rate)
        for batch in batches:
            parts, total = [], 0
            for _, data, marks in pieces(iter([batch]), text):
                hashes, bounds = word_hashes(data, marks)
                parts.append((vocabulary.tokens(hashes, bounds)[0], total))
                total += len(hashes)
            if parts:
                trainer.fit(_joined(parts))
        if trainer.seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([trainer.seen], pa.int64()), pa.array([vocabulary.shape.pack(trainer.net.p)], pa.binary())], names=["n", "params"]
            )

    return task


def _joined(parts: list[tuple[Tokens, int]]) -> Tokens:
    return Tokens(
        *[np.concatenate([getattr(t, k) for t, _ in parts]) for k in ("inputs", "classes", "words")],
        np.r_[0, np.concatenate([t.bounds[1:] + at for t, at in parts])],
    )


def _averaged(models: DataFrame, fan: int = 64) -> bytes | None:
    """Parameters averaged by tokens, ``fan`` models at a time, however many there are."""
    schema = "n bigint, params binary"

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["n"].sum()
        out = sum(np.frombuffer(x, np.float32) * (n / total) for n, x in zip(pdf["n"], pdf["params"]))
        return pd.DataFrame({"n": [total], "params": [out.astype(np.float32).tobytes()]})

    level = save(models, "models")
    while (count := level.count()) > 1:
        # Dealt in turn over the models' order, which their contents give.
        groups = F.pmod(F.xxhash64("params"), F.lit(-(-count // fan))) if count > fan else F.lit(0)
        level = save(level.groupBy(groups.alias("g")).applyInPandas(mean, schema), "models")
    row = level.first()
    return None if row is None else bytes(row["params"])


def frequent(counts: DataFrame, most: int) -> tuple[pd.DataFrame, int]:
    """The commonest words, ``most`` at most, and the count from which a word is one of them.

    A histogram of counts in steps of 1/64 of a power of two, some thousand rows, tells where to cut;
    so no more than ``most`` rows ever leave the cluster. The end of a text is always there.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).toPandas()
    steps = steps.sort_values("step", ascending=False)
    inside = steps[steps["words"].cumsum() < most]
    least = int(inside["least"].min()) if len(inside) else 1 << 62
    top = counts.filter((F.col("n") >= least) | (F.col("word") == END)).toPandas()
    return top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True), least


def train(
    documents: DataFrame, text: str, kin: str, key: Column, listed: int = 1 << 18, learnt: int = 1024,
    per_class: int = 32, hidden: int = 16, rate: float = 0.01,
) -> tuple[Vocabulary | None, bytes | None, DataFrame]:
    """Vocabulary, parameters and the counts of all words that are not listed. Every document is learnt from once:
    an eighth of them (by hash of ``key``) gives the common start of the others."""
    counts = save(word_counts(documents, text, kin), "counts")
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not sums[1]:
        return None, None, counts
    top, least = frequent(counts, listed)
    vocabulary = Vocabulary.of(top, int(sums[0]), int(sums[1]), learnt, per_class, hidden)
    packed = vocabulary.shape.pack(vocabulary.first())
    part = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(8))
    for chosen in (part == 0, part != 0):
        models = documents.filter(chosen).select(text).mapInArrow(
            _train(vocabulary, packed, text, rate), "n bigint, params binary"
        )
        packed = _averaged(models) or packed
    return vocabulary, packed, counts.filter((F.col("n") < least) & (F.col("word") != END))


SCORED = (
    "n_tokens bigint, listed bigint, base double, model double, "
    "rare array<bigint>, times array<bigint>"
)


def _score(vocabulary: Vocabulary, packed: bytes, text: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(vocabulary.shape, vocabulary.shape.unpack(packed))
        for batch in batches:
            parts, total, held = [], 0, []
            for rows, data, marks in pieces(iter([batch]), text):
                hashes, bounds = word_hashes(data, marks)
                tokens, at, hit = vocabulary.tokens(hashes, bounds)
                owner = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
                n = rows.num_rows
                lost = np.flatnonzero(~hit)
                # Rare words of each text, once each.
                order = np.lexsort((hashes[lost], owner[lost]))
                words, owners = hashes[lost][order], owner[lost][order]
                opens = np.ones(len(words), bool)
                opens[1:] = (words[1:] != words[:-1]) | (owners[1:] != owners[:-1])
                first = np.flatnonzero(opens)
                held.append((
                    np.bincount(owner, hit, n), np.bincount(owner, np.where(hit, vocabulary.logs[at], 0.0), n),
                    np.bincount(owner, np.where(hit, vocabulary.static[at], 0.0), n),
                    words[first].view(np.int64), np.diff(np.r_[first, len(words)]), np.bincount(owners[first], minlength=n),
                ))
                parts.append((tokens, total))
                total += len(hashes)
            if not parts:
                continue
            tokens = _joined(parts)
            logs = net.score(tokens)
            sums = np.add.reduceat(logs, tokens.bounds[:-1])
            known, base, static, words, times, sizes = (np.concatenate(x) for x in zip(*held))
            cuts = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text]
            names = [name for name in batch.schema.names if name != text]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(np.diff(tokens.bounds)), pa.array(known.astype(np.int64)), pa.array(base),
                 pa.array((sums + static) / LOG10), pa.ListArray.from_arrays(cuts, pa.array(words)),
                 pa.ListArray.from_arrays(cuts, pa.array(times))],
                names=[*names, *[c.split()[0] for c in SCORED.split(", ")]],
            )

    return task


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", kin_col: str | None = "lang", **settings
) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` says which rows are not learnt from. ``kin_col`` only shapes classes of words: what
    kind of document a training word stands in; it is not read when a text is scored.

    Defined cases: a null or empty text is its end alone. Repeated rows are learnt from as often as
    they are there and get equal scores. A null kin is a kin. Without training rows N, V and
    c are 0 and both scores are of an even guess. An empty table gives no rows.
    """
    kin = F.lit(0) if kin_col is None or kin_col not in docs.columns else F.pmod(F.xxhash64(F.col(kin_col)), F.lit(KINS)).cast("int")
    slim = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64(text_col).alias("th"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), kin.alias("kin"),
    )
    vocabulary, packed, counts = train(slim.filter(~F.col("held_out")), "text", "kin", F.col("th"), **settings)
    if vocabulary is None:
        # N = V = 0: every c + 1 over N + V + 1 is 1.
        nothing = pd.DataFrame({"word": pd.Series([END], dtype="int64"), "n": [0], "kin": [0]})
        vocabulary = Vocabulary.of(nothing, 0, 0, 1, 2, 2)
        packed = vocabulary.shape.pack(vocabulary.first())
    n, v = vocabulary.n, vocabulary.v
    kind = docs.schema[id_col].dataType.simpleString()
    scored = save(
        slim.select("id", "held_out", "th", "text").mapInArrow(
            _score(vocabulary, packed, "text"), f"id {kind}, held_out boolean, th bigint, {SCORED}"
        ),
        "scored",
    )
    # Counts of the words that no task has at hand. A first entry per row counts the rows of a key.
    rare_counts = counts.select("word", "n")
    long = scored.select("id", "th", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "id", "th", F.col("w.rare").alias("word"), F.col("w.times").alias("times")
    )
    looked = (
        long.join(rare_counts, "word", "left").groupBy("id", "th").agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("_logs"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
            F.sum("times").alias("_rare"),
        )
    )
    own = F.aggregate("times", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    joined = scored.withColumn("_own", own).join(
        looked.withColumnRenamed("id", "_id").withColumnRenamed("th", "_th"),
        F.col("id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th")), "left",
    )
    # Rows that are equal in id and text are summed together: each has its part.
    part = F.coalesce(F.try_divide(F.col("_own").cast("double"), F.col("_rare")), F.lit(0.0))
    logs = F.coalesce(F.col("_logs") * part, F.lit(0.0))
    known = F.coalesce(F.round(F.col("_known") * part), F.lit(0.0)).cast("bigint")
    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("listed") + known).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + logs - F.col("_own") * float(np.log10(vocabulary.rare_total))).alias("score"),
    )
