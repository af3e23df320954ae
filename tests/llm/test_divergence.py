import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from areaframe.llm import divergence
from areaframe.llm.divergence import audit, skyband, term_spans
from areaframe.llm.shared import texts

from .reference import lower

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, least, ranks):
    """docs: (lang, source, text)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        words = TERM.findall(lower(text))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})

        def shares(own):
            total = sum(own[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 2) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        each = {s: shares(counts[lang, s]) for s in sources}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            found = [("pair", u, sum(gap(each[s][t], each[u][t]) for t in kept)) for u in sources if u != s]
            found += [("term", t, gap(each[s][t], whole[t])) for t in kept if counts[lang, s][t] and each[s][t] > whole[t]]
            for part in ("pair", "term"):
                mine = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, i) for i, x in enumerate(mine, 1) if part == "pair" or i <= ranks]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "É", "ß", "Ti", "日", "zu") for b in ("", "mi", "x", "Na", "ü")]
    docs = []
    for _ in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "S3", "é", None, "other"])
        own = words[: 20 if source == "s2" else 35]
        docs.append((rng.choice(["en", "en", "fr", None]), source, rng.choice([" ", "_", "1", "\x7f"]).join(rng.choices(own, k=rng.randint(0, 30)))))
    return [*docs, ("en", "s1", None), ("en", "empty", ""), ("xx", "only", "a b"), ("yy", "p", "a"), ("yy", "q", None), ("en", "s2", "ka " * 4000), docs[0], docs[0]]


def test_equals_plain_counts(spark, monkeypatch):
    docs = corpus(400, 1)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, source string, text string, term string, n int")
    expected = plain(docs, 10, 10)
    assert len(expected) > 100
    assert got(audit(frame)) == expected
    # Several tiles and parts, and skybands taken while rows still come in.
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "PART", 5)
    assert got(audit(frame, least_docs=2, ranks=3)) == plain(docs, 2, 3)
    assert audit(frame.limit(0)).collect() == []


def test_skyband_holds_every_possible_top_row():
    rng = np.random.default_rng(0)
    for k in (1, 3, 10):
        n, against = rng.integers(1, 30, 900), rng.integers(1, 60, 900)
        dominated = np.tril((n >= n[:, None]) & (against <= against[:, None]), -1).sum(1)
        assert (skyband(n, against, k, block=64) == (dominated < k)).all()


def test_terms_end_with_their_text():
    data, marks = texts(pa.array(["ab", "cd", "", "é-f", None, "-", "g"]))
    starts, ends, bounds = term_spans(data, marks)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "cd", "é", "f", "g"]
    assert np.diff(bounds).tolist() == [1, 1, 0, 2, 0, 0, 1]


def test_query_equals_its_sql(spark, tiny):
    from areaframe.llm.queries import ORACLES, QUERIES

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    expected = sorted(connection.execute(ORACLES["op12_source_divergence"]).fetchall())
    assert got(QUERIES["op12_source_divergence"](spark, tiny)) == expected and expected
