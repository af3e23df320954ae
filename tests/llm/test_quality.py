import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from areaframe.llm.quality import Condition, DecisionList, cover, features, judge, learn, text_stats, with_stats
from areaframe.llm.shared import texts

from .reference import words

SYMBOLS = set("#*$%&|<>")


def plain_stats(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in SYMBOLS for c in text or ""),
        "n_dup_lines": repeated, "n_repeat_words": len(covered),
    }


def test_statistics_equal_plain_ones_on_random_texts():
    rng = random.Random(1)
    pieces = ["a", "bb", "#", "é", "日本", "\n", "\n", " ", " ", "\t", "***", "<x>", "word one two three four five six seven eight nine ", "\v", " ", "line\n"]
    sample = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(250)] + [None, "", " \n ", "a " * 5000, "x" * 30_000, "same line\n" * 300]
    got = text_stats(*texts(pa.array(sample)))
    for i, text in enumerate(sample):
        assert {k: int(got[k][i]) for k in plain_stats(text)} == plain_stats(text), repr(text[:80])


def plain_cover(x, bad, precision=0.95, least=4, cuts=48, most=4, most_rules=24):
    """Sequential covering written out row by row."""
    names, n = list(x), len(bad)
    left, rules = set(range(n)), []

    def met(rule, i):
        return all((x[f][i] >= t) if above else (x[f][i] < t) for f, above, t in rule)

    while len(rules) < most_rules:
        grow, prune = [i for i in sorted(left) if i % 3 != 2], [i for i in sorted(left) if i % 3 == 2]
        inside, rule = list(grow), []
        if not any(bad[i] for i in grow):
            break
        while len(rule) < most:
            p0 = sum(bad[i] for i in inside)
            n0 = len(inside) - p0
            if not p0 or not n0:
                break
            best, gained = None, 1e-9
            for f in names:
                own = [x[f][i] for i in inside if bad[i]]
                for t in sorted(set(np.quantile(own, np.linspace(0, 1, cuts)).tolist())):
                    for above in (True, False):
                        hit = [i for i in inside if ((x[f][i] >= t) if above else (x[f][i] < t))]
                        p = sum(bad[i] for i in hit)
                        if p:
                            gain = p * (math.log2(p / len(hit)) - math.log2(p0 / (p0 + n0)))
                            if gain > gained:
                                best, gained = (f, above, t), gain
            if best is None:
                break
            rule.append(best)
            inside = [i for i in inside if met([best], i)]
        if not rule:
            break
        worths = []
        for k in range(len(rule), 0, -1):
            hit = [i for i in prune if met(rule[:k], i)]
            p = sum(bad[i] for i in hit)
            worths.append(((round((2 * p - len(hit)) / len(hit), 6) if hit else -1.0), k))
        rule = rule[: max(worths)[1]]
        hit = [i for i in left if met(rule, i)]
        p = sum(bad[i] for i in hit)
        if p < least or p < precision * len(hit):
            break
        rules.append(tuple(rule))
        left -= set(hit)
    return rules


def test_covering_equals_one_written_out():
    learnt = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = {"a": rng.normal(size=240).round(2), "b": rng.integers(0, 6, 240).astype(float), "c": rng.normal(size=240).round(1)}
        bad = ((x["a"] > 0.8) & (x["b"] > 2)) | (x["c"] < -1.2)
        bad ^= rng.random(240) < 0.01 * seed
        got = [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in cover(x, bad).rules]
        assert got == plain_cover(x, bad.tolist())
        learnt += len(got)
    assert learnt > 3
    assert cover({"a": np.zeros(0)}, np.zeros(0, bool)).rules == ()
    assert cover({"a": np.ones(50)}, np.ones(50, bool)).rules == ()


def document(rng, bad):
    own = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(30, 60))]
    if bad:
        own = [w + rng.choice(["***", "$$$", "%%%"]) for w in own]
    return " ".join(own)


def test_learning_and_judging(spark):
    rng = random.Random(5)
    docs = [(i, document(rng, i % 4 == 0)) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "few words"), (1003, document(rng, True)), (1003, document(rng, False)), (None, document(rng, True))]
    frame = spark.createDataFrame([(*d, 7, False) for d in docs], "doc_id bigint, text string, n_words int, kept boolean").repartition(3)
    # Labels that disagree: the commoner counts, ties are good; nulls and unknown documents teach nothing.
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(300)] + [(1, 0), (2, 0), (2, 1), (None, 0), (5, None), (77_777, 0)]
    stats = with_stats(frame)
    rules = learn(stats.drop("text"), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert rules.rules
    got = judge(stats, rules).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.kept == (r.doc_id % 4 != 0)
        assert r.base_failed == (len(words(r.text)) < 20)
    assert sorted(r.kept for r in got if r.doc_id == 1003) == [False, True]
    assert not any(r.kept for r in got if r.doc_id in (1000, 1001, 1002, None))
    nothing = learn(stats.drop("text"), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert nothing.rules == () and judge(stats.limit(0), rules).collect() == []


def test_a_value_at_the_threshold_is_above(spark):
    rules = DecisionList(((Condition("words", True, 30.0),), (Condition("words", False, 21.0),)))
    frame = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (20, 21, 29, 30)], "doc_id int, text string")
    got = {r.doc_id: r.kept for r in judge(with_stats(frame), rules).collect()}
    assert got == {20: False, 21: True, 29: True, 30: False}
    x = {"words": np.array([20.0, 21, 29, 30])}
    assert rules.holds(x).tolist() == [False, True, True, False]
    assert set(features()) >= {"words", "symbols_per_char"}
