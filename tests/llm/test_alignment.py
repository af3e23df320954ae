import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from areaframe.llm import alignment
from areaframe.llm.alignment import BYTE_BPE, PIECE_BPE, align, byte_letters, load, piece_bytes

TEXTS = [
    None, "", " ", "  ", "a ", " a", "a  ", "\n", "\ta b\n\n c", "The cat's hat, isn't it?", "né 日本語 \U0001f9ffx  a\n b", "▁x y",
    "<|endoftext|> and </s> <s> <unk>", "<0x41> <0x0A>", "a b c　d e", "x" * 3000, "wörd " * 500, "né é  \U0001f468‍\U0001f469 " * 9,
    "\r\n a\x00b \x1f c \x7f d", "ﬁ Å", "The cat's hat, isn't it?", "é a ñ b ß c 日 d",
]


def plain(docs):
    """By whole texts, token by token."""
    own, letters = load(BYTE_BPE, PIECE_BPE), byte_letters()
    found, held, n = [], Counter(), 0
    for key, text in docs:
        links, row = [], (0, 0, 0, 0, "")
        if text:
            ids_a = own.a.encode(" " + text, add_special_tokens=False).ids
            ids_b = own.b.encode(text, num_threads=1)
            a = [bytes(letters[c] for c in own.a.id_to_token(i)) for i in ids_a]
            b = [piece_bytes(own.b.id_to_piece(i)) for i in ids_b]
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (a, b))
                at = 0
                for i, end in enumerate(ends_a):
                    while at < len(ends_b):
                        links.append((ids_a[i], ids_b[at]))
                        if ends_b[at] > end:
                            break
                        at += 1
                        if ends_b[at - 1] == end:
                            break
                groups, ga, gb, j = [], [], [], 0
                common = set(ends_a) & set(ends_b)
                for i, end in enumerate(ends_a):
                    ga.append(str(ids_a[i]))
                    if end in common:
                        while True:
                            gb.append(str(ids_b[j]))
                            j += 1
                            if ends_b[j - 1] == end:
                                break
                        groups.append(",".join(ga) + "|" + ",".join(gb))
                        ga, gb = [], []
                row = (len(a), len(b), len(groups), len(links), ";".join(groups))
        held.update(set(links))
        found.append((key, row, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return sorted(
        (str(k), *r[:4], sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), r[4]) for k, r, links in found
    )


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def test_equals_whole_texts_token_by_token(spark):
    docs = [*enumerate(TEXTS), (3, "again  under an id"), (None, "no id"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id int, text string, n_a int, block string")
    expected = plain(docs)
    assert sum(r[2] > 0 for r in expected) > 15 and any(r[1] == 0 and r[0] == "11" for r in expected)
    for partitions in (1, 7):
        assert got(align(frame.repartition(partitions))) == expected
    assert align(frame.limit(0)).collect() == []


def test_random_mixtures_in_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    letters = ["a", "the", " ", " ", "  ", "\n", "é", "日", "\U0001f9ff", "'s", "12", " ", " ", "▁", ".", "ing", "\t", "ß"]
    docs = [(i, "".join(rng.choices(letters, k=rng.randint(1, 60)))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert got(align(frame)) == plain(docs)


def test_query_on_the_given_table(spark, tiny):
    from areaframe.llm.queries import QUERIES, table

    docs = [(r.doc_id, r.text) for r in table(spark, tiny, "documents").collect()]
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in plain(docs)]
    rows = QUERIES["op11_tokenizer_alignment"](spark, tiny).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == expected


def test_given_vocabularies_can_be_cut():
    own = load(BYTE_BPE, PIECE_BPE)
    assert own.separable and len(byte_letters()) == 256
