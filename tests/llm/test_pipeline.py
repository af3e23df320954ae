"""The stages of the corpus pipeline on a small table with odd rows, each against a plain version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from areaframe.llm.lines import dedup_lines
from areaframe.llm.quality import judge, learn, with_stats

from .reference import lower, shingles, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n, own=400):
    return " ".join(f"w{rng.randint(0, own)}" for _ in range(n))


def corpus():
    rng = random.Random(8)
    docs = [(i, sentence(rng, rng.randint(25, 90)), "en", rng.choice(["a", "b", "c", None])) for i in range(240)]
    for i in range(30):  # copies, near copies, and texts that share a line
        base = docs[i]
        docs.append((1000 + i, base[1], "en", "b"))
        docs.append((2000 + i, base[1] + " tail", "fr", "c"))
        docs.append((3000 + i, sentence(rng, 30) + "\nThis line stands in many documents\n" + sentence(rng, 30), "en", "a"))
    docs += [(5, docs[200][1], "en", "a"), (5, sentence(rng, 40), "en", "a"), (7, docs[7][1], "en", docs[7][3])]
    docs += [(None, docs[9][1], "en", "a"), (None, sentence(rng, 40), "en", "a"), (None, sentence(rng, 40), "en", "a")]
    docs += [(6000, None, "en", "a"), (6001, "", None, None), (6002, " \n ", "en", "b"), (6003, "word", "en", "c"), (6004, "x" * 50_000, "en", "c")]
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Name -> (rows in, rows out) of every stage but the last, and the last one's rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(4, 1, None), (4, 0, None), (None, 1, 0), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out, frame = {}, spark.read.schema(SCHEMA).parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{folder}/{i}")
        done = spark.read.parquet(f"{folder}/{i}")
        out[name] = [tuple(r) for r in frame.collect()], [tuple(r) for r in done.collect()], done.columns
        frame = done
    out["folder"] = folder
    return out


def test_quality_is_the_operators_verdict(spark, stages):
    before, after, columns = stages["quality_rules"]
    assert columns == COLUMNS and not Counter(after) - Counter(before)
    frame = spark.createDataFrame(before, SCHEMA)
    stats = with_stats(frame)
    rules = learn(stats.drop("text", "lang", "source", "n_chars"), spark.read.parquet(f"{stages['folder']}/labels.parquet"))
    kept = [tuple(r) for r in judge(stats, rules).filter("kept").select(*COLUMNS).collect()]
    assert Counter(kept) == Counter(after)
    # The base rule, plainly: too few words.
    assert all(len(words(d[1])) >= 20 for d in after) and len(after) > 200


def test_lines_are_dropped_but_where_the_smallest_id_holds_them(stages):
    before, after, columns = stages["line_dedup"]
    assert columns == COLUMNS

    def key(line):
        return lower(line.strip(" \t\n\v\f\r"))

    holders = {}
    for d in before:
        if d[0] is not None and d[1] is not None:
            for line in d[1].split("\n"):
                holders.setdefault(key(line), set()).add(d[0])
    expected = []
    for d in before:
        lines = (d[1] or "").split("\n")
        left = [x for x in lines if d[0] is None or len(key(x)) < 10 or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d[0]]
        text = "\n".join(left) if len(left) < len(lines) else d[1]
        expected.append((d[0], text, *d[2:4], len(text) if len(left) < len(lines) else d[4]))
    assert Counter(after) == Counter(expected) and Counter(after) != Counter(before)


def test_one_row_of_each_group_stays(stages):
    before, after, columns = stages["near_dedup"]
    assert columns == COLUMNS and not Counter(after) - Counter(before)
    sets = [shingles(d[1], 5) for d in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(before):
        groups.setdefault(find(i) if sets[i] else ("alone", i), []).append(d)
    # From every group exactly one row, with the smallest id.
    left = Counter(after)
    assert len(after) == len(groups) < len(before)
    for rows in groups.values():
        ids = [d[0] for d in rows if d[0] is not None]
        best = [d for d in rows if d[0] == (min(ids) if ids else None)]
        assert sum(left[d] > 0 for d in set(best)) >= 1
        assert not any(left[d] for d in set(rows) - set(best))


def test_mixing_repeats_and_drops_whole_documents(stages):
    before, after, columns = stages["mixing"]
    assert columns == COLUMNS and not set(after) - set(before)
    most = Counter(before)
    assert all(n <= 2 * most[d] for d, n in Counter(after).items())
    sizes = Counter()
    for d in before:
        sizes[d[3]] += len(words(d[1]))
    taken = Counter()
    for d in after:
        taken[d[3]] += len(words(d[1]))
    # Targets by weight 3, 1, 2 in order of source, null last, none above twice its size.
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, rest, target = set(order), 1.5 * sum(sizes.values()), {}
    while True:
        level = rest / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not capped:
            break
        target |= {s: 2.0 * sizes[s] for s in capped}
        rest -= sum(target[s] for s in capped)
        free -= capped
    target |= {s: weight[s] * level for s in free}
    smallest = max(len(words(d[1])) for d in before)
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.005 * target[s], smallest)


def test_every_text_is_encoded_and_comes_back(stages):
    before, after, columns = stages["sentencepiece"]
    assert columns == ["doc_id", "source", "token_ids", "n_tokens", "round_trip"]
    assert len(after) == len(before) and all(r[4] for r in after if r[2] is not None)


def test_no_documents(spark, stages, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, empty, stages["folder"])
        assert done.collect() == [], name
