import random

from areaframe.llm.graph import components


def smallest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def check(spark, edges, kind, chunk):
    frame = spark.createDataFrame(edges, f"x {kind}, y {kind}").repartition(5)
    got = [tuple(r) for r in components(frame, chunk=chunk).collect()]
    proper = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert len(got) == len(dict(got))
    assert dict(got) == smallest(proper)


def test_paths_hubs_and_odd_edges(spark):
    rng = random.Random(5)
    path = list(range(-40, 60))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, n) for n in range(1001, 1030)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(110)]
    edges += [(7, 7), (None, 3), (3, None), (1000, 1001), (1001, 1000)]
    # Chunks of three edges leave nearly all to the rounds, large ones to the first task.
    check(spark, edges, "bigint", 3)
    check(spark, edges, "bigint", 1 << 20)


def test_text_nodes_and_no_edges(spark):
    check(spark, [("b", "a"), ("c", "b"), ("é", "z"), ("z", "\U0001f600")], "string", 1)
    empty = spark.createDataFrame([], "x bigint, y bigint")
    assert components(empty).collect() == []
