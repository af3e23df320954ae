"""Quality rules: statistics of whole texts, and decision lists learnt from labels.

Sequential covering: grow a conjunction of thresholds on one part of the labelled rows by
information gain, prune it on the other, take out what it covers, go on. What is learnt is
a short ordered list of Spark conditional expressions, so applying it is part of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import extend, extended, pieces
from .words import Hasher, U, code_points, line_spans, mix, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?")] = True
WINDOW = 8

STATS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "n_lines": "bigint", "n_distinct_words": "bigint",
    "n_upper": "bigint", "n_digits": "bigint", "n_marks": "bigint",
}


def _per_text(flags: np.ndarray, marks: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[marks[1:]] - sums[marks[:-1]]


def _groups(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of (text, hash), and which of them open a new group."""
    keys = mix(hashes + (owner.astype(np.uint64) + U(1)) * U(0xE7037ED1A0B428DB))
    order = np.argsort(keys, kind="stable")
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[order][1:] != keys[order][:-1]
    return order, opens


def text_stats(data: np.ndarray, marks: np.ndarray) -> dict[str, np.ndarray]:
    n = len(marks) - 1
    starts, ends, bounds = word_spans(data, marks)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n), n_words)
    points = code_points(data)
    hashes = Hasher(data)
    words = hashes(starts, ends)

    def count(values: np.ndarray) -> np.ndarray:
        return np.bincount(values, minlength=n)[:n]

    order, opens = _groups(owner, words)
    distinct = count(owner[order][opens])

    # Windows of words: all that occur twice or more in their text cover their words.
    repeated = np.zeros(len(words) + 1, np.int64)
    size = len(words) - WINDOW + 1
    if size > 0:
        rolled = np.zeros(size, np.uint64)
        for j in range(WINDOW):
            rolled += words[j : j + size] * U(pow(0x9FB21C651E98DF25, j + 1, 2**64))
        whole = np.flatnonzero(owner[:size] == owner[WINDOW - 1 :])
        order, opens = _groups(owner[whole], mix(rolled[whole]))
        group = np.cumsum(opens) - 1
        twice = whole[order[(np.bincount(group) > 1)[group]]] if len(group) else whole
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    covered = np.cumsum(repeated)[:-1] > 0

    a, b, lines = line_spans(data, marks)
    n_lines = np.diff(lines)
    said = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    line_owner = np.repeat(np.arange(n), n_lines)[said]
    order, opens = _groups(line_owner, hashes(a[said], b[said]))
    return {
        "n_words": n_words,
        "word_chars": np.bincount(owner, points[ends] - points[starts], n).astype(np.int64)[:n],
        "n_symbols": _per_text(SYMBOLS[data], marks),
        "n_dup_lines": count(line_owner[order][~opens]),
        "n_repeat_words": count(owner[covered]),
        "n_lines": n_lines,
        "n_distinct_words": distinct,
        "n_upper": _per_text(UPPER[data], marks),
        "n_digits": _per_text(DIGIT[data], marks),
        "n_marks": _per_text(MARKS[data], marks),
    }


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of :data:`STATS` (in place of columns of these names)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, text_col):
            yield extend(rows, {k: pa.array(v) for k, v in text_stats(data, marks).items()})

    return docs.mapInArrow(task, extended(docs, STATS))


def features() -> dict[str, Column]:
    """What rules may look at: sizes and shares, 0 where there is nothing to share."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "lines": F.col("n_lines").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "symbols_per_char": share("n_symbols", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "upper_per_char": share("n_upper", "word_chars"),
        "digits_per_char": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.above else x < self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.above else c < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions in order; the first that holds rejects, a row that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            every = rule[0].column()
            for condition in rule[1:]:
                every = every & condition.column()
            verdict = F.when(every, False) if verdict is None else verdict.when(every, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.zeros(n, bool)
        for rule in self.rules:
            out |= np.all([c.of(x[c.feature]) for c in rule], axis=0)
        return ~out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, most: int) -> list[Condition]:
    inside = np.ones(len(bad), bool)
    rule: list[Condition] = []
    while len(rule) < most:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p0 == 0 or n0 == 0:
            break
        best, gained = None, 1e-9
        for name, values in x.items():
            own, own_bad = values[inside], bad[inside]
            # Cuts at the rejected rows' own values: there a threshold can matter.
            for t in np.unique(np.quantile(own[own_bad], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    at = own >= t if above else own < t
                    p, n = int(own_bad[at].sum()), int((~own_bad[at]).sum())
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > gained:
                            best, gained = Condition(name, above, float(t)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.of(x[best.feature])
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    hit = np.all([c.of(x[c.feature]) for c in rule], axis=0)
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def cover(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 4,
    cuts: int = 48, most: int = 4, most_rules: int = 24,
) -> DecisionList:
    """The list for rows of features and which of them are bad. A rule enters only when of what
    it covers, in both parts together, ``precision`` is bad and ``least`` rows or more are."""
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < most_rules and bad[left & ~part].any():
        grow, prune = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], cuts, most)
        if not rule:
            break
        lengths = range(len(rule), 0, -1)
        slim = {k: v[prune] for k, v in x.items()}
        rule = rule[: max(lengths, key=lambda k: (round(_worth(rule[:k], slim, bad[prune])[0], 6), k))]
        _, p, n = _worth(rule, {k: v[left] for k, v in x.items()}, bad[left])
        if p < least or p < precision * (p + n):
            break
        rules.append(tuple(rule))
        left &= ~np.all([c.of(x[c.feature]) for c in rule], axis=0)
    return DecisionList(tuple(rules))


def learn(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    most_rows: int = 20_000,
) -> DecisionList:
    """A list learnt from labelled rows, at most ``most_rows`` of them: those with the smallest
    hash of their id. A document whose labels disagree takes the commoner, ties good;
    labels that are null or without a document teach nothing."""
    votes = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .filter("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.avg("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    )
    measured = features()
    table = (
        stats.select(id_col, *STATS).join(votes, F.col(id_col) == F.col("_id"))
        .select("_id", "_y", *[c.alias(name) for name, c in measured.items()])
        .orderBy(F.xxhash64("_id"), "_id").limit(most_rows).toPandas()
    )
    x = {name: table[name].to_numpy(float) for name in measured}
    return cover(x, table["_y"].to_numpy(float) < 0.5)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds ``base_failed`` and ``kept``.

    Defined cases: a null or wordless text has no words and fails the base rule. Every row
    is judged by its own text, repeated rows alike. Computed columns take the place of
    columns of their names; an empty table stays empty.
    """
    return stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & rules.kept()})
