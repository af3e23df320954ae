import numpy as np
import pytest

from areaframe.llm.neighbours import Descent, near_vectors


def plain(rows, least=0.93):
    """vec_id -> (n_links, component_id) by comparing all pairs."""
    units = {}
    for i, vector, label in rows:
        if vector and label is not None and None not in vector:
            x = np.array(vector, np.float64)
            if np.isfinite(x).all() and x.any():
                units[i] = (label, x / np.linalg.norm(x))
    links = {i: set() for i, _, _ in rows}
    for i, (la, a) in units.items():
        for j, (lb, b) in units.items():
            if i != j and la == lb and len(a) == len(b) and a @ b >= least:
                links[i].add(j)
    out = {}
    for i in links:
        reached, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(reached))
    return out


def families(seed, count, size, noise, width=24):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(count):
        base = rng.standard_normal(width)
        for _ in range(size):
            out.append(((base + noise * rng.standard_normal(width)).tolist(), f % 3))
    return out


ODD = [
    (None, 1), ([], 1), ([0.0] * 24, 1), ([1.0] * 23 + [None], 1), ([1.0] * 23 + [float("nan")], 1),
    ([float("inf")] + [1.0] * 23, 1), ([1.0] * 24, None), ([1.0] * 24, None), ([1.0] * 24, 2), ([1.0] * 24, 2),
    ([2.0] * 24, 2), ([1.0] * 24, 0), ([1.0] * 25, 2), ([1.0] * 25, 2),
]


@pytest.mark.parametrize("block", [8, 256])
def test_equals_all_pairs(spark, block):
    rows = families(1, 40, 6, 0.2) + families(2, 2, 60, 0.15) + families(3, 60, 1, 0.0) + ODD
    rows = [(i + 5, v, label) for i, (v, label) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    found, report = near_vectors(frame, params=Descent(block=block))
    listed = found.collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in listed} == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in listed)
    assert report["recall"] >= 0.9


def test_repeated_and_missing_ids_clashing_columns_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int, n_links string, node string"
    rows = [(4, [1.0, 0.0], 1, "x", "y"), (4, [1.0, 0.0], 1, "x", None), (None, [1.0, 0.01], 1, None, None)]
    frame = spark.createDataFrame([*rows, (None, None, None, None, None)], schema)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(frame)[0].collect())
    assert got == [("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 2, "4", False)]
    assert near_vectors(frame.limit(0))[0].collect() == []


@pytest.mark.parametrize("block", [16, 256])
def test_clumps_larger_than_a_list_that_only_weaker_links_join(spark, block):
    rng = np.random.default_rng(11)
    axes, rows = np.linalg.qr(rng.standard_normal((24, 24)))[0], []
    # Clumps of 60 within 0.99; clumps 2k and 2k + 1 at 0.94, the others apart.
    for k in range(4):
        for turned in (0.0, np.arccos(0.94)):
            middle = np.cos(turned) * axes[2 * k] + np.sin(turned) * axes[2 * k + 1]
            rows += [((middle + 0.004 * rng.standard_normal(24)).tolist(), 1) for _ in range(60)]
    rows = [(i, v, label) for i, (v, label) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    found, report = near_vectors(frame, params=Descent(block=block, audited=0))
    listed = found.collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in listed} == plain(rows)
    assert len({r.component_id for r in listed}) == 4


@pytest.mark.parametrize("count, size, partitions", [(3, 2, 1), (3, 2, 64), (40, 5, 7)])
def test_descent_alone_finds_the_links(spark, count, size, partitions):
    """Without an audit, on tables of a few rows and more, however they are dealt."""
    rows = [(i, v, label) for i, (v, label) in enumerate(families(9, count, size, 0.12) + families(10, 2, 1, 0.0))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(partitions)
    found, _ = near_vectors(frame, params=Descent(audited=0))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == plain(rows)
