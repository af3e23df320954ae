import random
from collections import Counter, defaultdict

import pytest

from areaframe.llm.mixing import mix_sources
from areaframe.llm.queries import QUERIES, table

from .reference import words


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes: source -> words. By dealing out again what passes the caps until nothing does."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, rest, out = set(order), share * sum(sizes.values()), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * level > most * sizes[s]}
        if not capped:
            return out | {s: weight[s] * level for s in free}
        out |= {s: most * sizes[s] for s in capped}
        rest -= sum(out[s] for s in capped)
        free -= capped
    return out


def test_every_source_meets_its_target(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a", "b", "b", "b", None, "é"]), int(rng.lognormvariate(4, 1.4))) for i in range(9000)]
    docs += [(90_000 + i, "few", 10 * i + 1) for i in range(4)] + [(99_999, "big", 60_000), (1, "none", 0), (2, "none", None)]
    frame = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id bigint, source string, size bigint, target double")
    got = mix_sources(frame.repartition(5)).collect()
    rows = [(r.source, r["size"] or 0, r.source_size, r.target, r.times) for r in got]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    expected = targets(Counter({s: sum(n or 0 for _, t, n in docs if t == s) for s in {d[1] for d in docs}}))
    for s, mine in by.items():
        assert mine[0][3] == pytest.approx(expected[s])
        least = min([n for _, n, *_ in mine if n] or [0])
        # A source of a few large documents can only come as near as these allow.
        room = {"few": 31, "big": 60_000}.get(s, max(0.005 * expected[s], least))
        assert abs(sum(r[1] * r[4] for r in mine) - expected[s]) <= room
    again = mix_sources(frame.repartition(2)).collect()
    assert Counter((r.doc_id, r.times) for r in again) == Counter((r.doc_id, r.times) for r in got)


def test_rows_alike_are_taken_alike_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "a", 5), (2, "a", 7)] * 3, "doc_id bigint, source string, size bigint")
    got = mix_sources(frame).collect()
    assert len(got) == 12 and all(len({r.times for r in got if r.doc_id == i}) == 1 for i in (1, 2, None))
    assert mix_sources(frame.limit(0)).collect() == []


def test_the_query_on_the_given_tables(spark, small):
    docs = {r.doc_id: (r.source, len(words(r.text))) for r in table(spark, small, "documents").collect()}
    rows = QUERIES["op2_mixing"](spark, small).collect()
    assert len(rows) == len(docs)
    sizes, taken, least = Counter(), Counter(), {}
    for r in rows:
        s, n = docs[r.doc_id]
        assert r["size"] == n and r.taken in (0, n, 2 * n)
        sizes[s] += n
        taken[s] += r.taken
        least[s] = min(n, least.get(s, n))
    expected = targets(sizes)
    for r in rows:
        s = docs[r.doc_id][0]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert abs(taken[s] - expected[s]) <= max(0.005 * expected[s], least[s]), (s, taken[s], expected[s])
