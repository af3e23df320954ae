import numpy as np
import pyarrow as pa
import random

from areaframe.llm import graph, minhash
from areaframe.llm.minhash import MinHash, near_duplicates
from areaframe.llm.shared import save

from .reference import near_duplicate_components


def variants(seed, families, copies):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(lexicon) for _ in range(rng.randint(30, 90))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(lexicon)
            out.append(" ".join(own))
    return out


def check(spark, texts, params):
    docs = [(i + 10, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in near_duplicates(frame, params=params).collect()
    }
    assert got == near_duplicate_components(docs, params.shingle, params.percent)


def test_equals_all_pairs(spark):
    odd = [None, "", "  \n\t", "one", "One", "a b", "a  B", "x" * 5000, "the same words here now"]
    check(spark, odd + variants(1, 25, 6), MinHash(shingle=2))


def test_blocks_lose_no_link(spark):
    check(spark, variants(2, 2, 60) + variants(3, 5, 3), MinHash(shingle=2, block=16))


def test_five_words_and_odd_rows(spark):
    check(spark, variants(4, 10, 8), MinHash())
    frame = spark.createDataFrame(
        [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None),
         (None, None, None), (7, "q r s t u v", None)],
        "doc_id bigint, text string, n_shingles string",
    )
    rows = near_duplicates(frame).collect()
    assert sorted(((str(r.doc_id), r.component_id, r.kept) for r in rows), key=str) == [
        ("1", 1, True), ("1", 1, True), ("7", 7, True), ("None", 1, False), ("None", None, True)
    ]
    assert near_duplicates(frame.limit(0)).collect() == []


def test_known_components_of_negative_name_are_not_compared_again():
    items = np.arange(9, dtype=np.uint64).tobytes()
    batch = pa.RecordBatch.from_pydict({
        "unit": pa.array([1] * 3, pa.int64()), "side": pa.array([0] * 3, pa.int32()), "cid": pa.array([-7, 3, 5], pa.int64()),
        "part": pa.array([-7, -7, 5], pa.int64()), "n": pa.array([9] * 3, pa.int64()), "items": pa.array([items] * 3, pa.binary()),
        "signature": pa.array([np.zeros(4, np.uint16).tobytes()] * 3, pa.binary()),
    })
    found = [(r["a"], r["b"]) for out in minhash._links(minhash.MinHash())(iter([batch])) for r in out.to_pylist()]
    assert found == [(-7, 5)]


def test_no_side_of_a_join_goes_through_the_driver(spark, monkeypatch):
    """Sides grow with the corpus; small ones were broadcast, which the driver's memory bears up to some size only."""
    plans = []

    def planned(df, what="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, what)

    monkeypatch.setattr(minhash, "save", planned)
    monkeypatch.setattr(graph, "save", planned)
    # Some groups are cut into blocks, so that every join is met.
    texts = variants(2, 2, 60) + variants(3, 5, 3)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id bigint, text string")
    params = MinHash(shingle=2, block=16)
    plans.append(near_duplicates(frame, params=params)._jdf.queryExecution().executedPlan().toString())
    minhash.representatives(frame, params=params)
    assert sum("SortMergeJoin" in p for p in plans) >= 12
    assert not [p for p in plans if "Broadcast" in p]
