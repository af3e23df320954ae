import random

import numpy as np

from areaframe.llm import lines
from areaframe.llm.cuckoo import CuckooFilter
from areaframe.llm.lines import dedup_lines, delete, empty_index, insert, line_references

from .reference import lower


def test_removing_many_keys_at_once():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 50_000)
    held = CuckooFilter.sized(len(keys))
    assert held.insert(keys)
    held.remove(keys[::2])
    assert held.contains(keys[1::2]).all() and held.contains(keys[::2]).mean() < 0.01
    held.remove(keys[1::2])
    assert not held.table.any()
    again = CuckooFilter.sized(1000)
    twice = np.repeat(keys[:300], 2)
    assert again.insert(twice)
    again.remove(keys[:300])
    assert again.contains(keys[:300]).all()
    again.remove(keys[:300])
    assert not again.table.any()


def corpus(n, seed):
    rng = random.Random(seed)
    shared = [f"A line that many share, number {i}" for i in range(60)]
    return [(i, "\n".join(rng.choice(shared) if rng.random() < 0.5 else f"own {i} {j} words" for j in range(rng.randint(0, 8)))) for i in range(n)]


def plain(docs):
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if d is not None:
                holders.setdefault(lower(line.strip(" \t\n\v\f\r")), set()).add(d)
    out = []
    for d, text in docs:
        own = (text or "").split("\n")
        keys = [lower(x.strip(" \t\n\v\f\r")) for x in own]
        left = [x for x, k in zip(own, keys) if d is None or len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == d]
        out.append((str(d), len(own), len(own) - len(left), "\n".join(left) if len(left) < len(own) else text))
    return sorted(out, key=str)


def test_batches_ask_the_filters_and_shards_go_by_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 200)
    asked = []
    own = lines._filtered
    monkeypatch.setattr(lines, "_filtered", lambda keys, index, what: asked.append((what, index.shards, index.filters.count())) or own(keys, index, what))
    docs = corpus(300, 1) + [(None, "A line that many share, number 1"), (7, "own 7 0 words\nA second text of this id"), (900, None), (901, "x" * 30_000)]
    frame = spark.createDataFrame([(*d, "n") for d in docs], "doc_id bigint, text string, n_lines string").repartition(3)
    got = dedup_lines(frame).collect()
    assert sorted(((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got), key=str) == plain(docs)
    shards = {n for _, n, _ in asked}
    assert len(shards) == 1 and shards.pop() > 3
    # The second probe meets filled filters.
    assert [filled > 0 for what, _, filled in asked if what == "probe"] == [False, True]
    assert dedup_lines(frame.limit(0)).collect() == []


def test_three_batches_and_a_deletion_between_equal_a_rebuild(spark):
    docs = corpus(240, 2)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")

    def references(some):
        return line_references(some, "doc_id", "text")

    index = insert(empty_index(spark), references(frame.filter("doc_id < 80")))
    index = insert(index, references(frame.filter("doc_id >= 80 AND doc_id < 160")))
    index = delete(index, frame.filter("doc_id % 3 = 0 AND doc_id < 160").select("doc_id"))
    index = insert(index, references(frame.filter("doc_id >= 160")))
    fresh = insert(empty_index(spark), references(frame.filter("NOT (doc_id % 3 = 0 AND doc_id < 160)")))
    assert sorted(map(tuple, index.shared().collect())) == sorted(map(tuple, fresh.shared().collect()))
    assert sorted(map(tuple, index.references().collect())) == sorted(map(tuple, fresh.references().collect()))
