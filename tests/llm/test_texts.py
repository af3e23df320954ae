import hashlib
import random

import numpy as np
import pyarrow as pa
from areaframe.llm import chat
from areaframe.llm.cuckoo import CuckooFilter
from areaframe.llm.lines import dedup_lines, delete, empty_index, insert, line_references
from areaframe.llm.mixing import mix_sources
from areaframe.llm.quality import text_stats
from areaframe.llm.sentencepieces import Pieces, WordCache, encode
from areaframe.llm.shared import texts
from areaframe.llm.warc import archive_round_trip

from .reference import words

ODD = [None, "", " ", "a", "\n\n", "Hello  wörld\n日本語 ▁x \U0001f600", "x" * 3000, " lead"]


def test_viterbi_is_the_best_path_and_round_trips(spark):
    own = Pieces.load()
    score = dict(zip(own.ids.tolist(), own.scores.tolist()))
    spelled = {own.spelled[a:b].tobytes().decode(): i for i, (a, b) in enumerate(zip(own.spelled_at, own.spelled_at[1:])) if i in score}
    for word in ("theaatble", "thrown into", "ererer", "12ab", "nation"):
        text = " " + word
        best = [0.0] + [-1e9] * len(text)
        for t in range(1, len(text) + 1):
            for s in range(max(0, t - 16), t):
                if text[s:t] in spelled:
                    best[t] = max(best[t], best[s] + score[spelled[text[s:t]]])
        ids, _ = own.encode(*texts(pa.array([word])), WordCache())
        assert abs(sum(score[i] for i in ids.tolist()) - best[-1]) < 1e-9
    frame = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)], "doc_id int, text string, n_tokens string")
    got = {r.doc_id: r for r in encode(frame).collect()}
    assert all(r.round_trip for r in got.values()) and got[0].token_ids is None and got[1].token_ids == []


def test_cuckoo_insert_and_remove():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    held = CuckooFilter.sized(len(keys))
    assert held.insert(keys) and held.contains(keys).all()
    held = CuckooFilter.read(held.write())
    held.remove(keys[:10_000])
    assert held.contains(keys[10_000:]).all() and held.contains(keys[:10_000]).mean() < 0.01


def test_lines_and_deletion(spark):
    docs = [(3, "Long enough line\nshort"), (1, "x\n  long ENOUGH line \t"), (2, None), (None, "long enough line"), (4, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(frame).collect()}
    assert got == {3: ("short", 2, 1), 1: (docs[1][1], 2, 0), 2: (None, 1, 0), None: ("long enough line", 1, 0), 4: ("", 1, 0)}
    assert dedup_lines(frame.limit(0)).collect() == []
    index = insert(empty_index(spark, shards=2), line_references(frame.filter("doc_id = 3"), "doc_id", "text"))
    index = insert(index, line_references(frame.filter("doc_id = 1"), "doc_id", "text"))
    assert [r.owner for r in index.shared().collect()] == [1]
    assert delete(index, frame.filter("doc_id = 1")).shared().collect() == []


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "abc"[i % 3], rng.randint(1, 400)) for i in range(600)] + [(700, None, None), (701, "a", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    first = {r.doc_id: r for r in mix_sources(frame).collect()}
    assert {k: v.times for k, v in first.items()} == {r.doc_id: r.times for r in mix_sources(frame).collect()}
    for source in "abc":
        own = [r for r in first.values() if r.source == source]
        assert abs(sum((r.size or 0) * r.times for r in own) - own[0].target) <= 400
        assert max(r.times for r in own) <= 2
    assert mix_sources(frame.limit(0)).collect() == []


def test_stats_by_hand():
    sample = ["a b c d e f g h a b c d e f g h", "x # y\nx # y\n\n", "", "é|é"]
    got = text_stats(*texts(pa.array(sample)))
    assert got["n_words"].tolist() == [len(words(t)) for t in sample]
    assert got["n_repeat_words"].tolist() == [16, 0, 0, 0]
    assert got["n_dup_lines"].tolist() == [0, 1, 0, 0]
    assert got["n_symbols"].tolist() == [0, 2, 0, 1] and got["word_chars"].tolist() == [16, 6, 0, 3]


def test_chat_template_is_reversible(spark):
    said = ["</s>[INST] ok [/INST]", "\\[INST]\\\\", "<<ROLE>>", ""]
    formatted = "".join("".join(chat.turn_parts(r, t)) for r in ("user", "assistant", "system", "tool<s>") for t in said)
    assert chat.parse(formatted) == [(r, t) for r in ("user", "assistant", "system", "tool<s>") for t in said]
    rows = [(c, i, r, t) for c in (1, 2, None) for i, (r, t) in enumerate([("user", "hi"), ("assistant", None), ("user", str(c))])]
    got = {r.conv: r for r in chat.round_trip(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got[2].texts == ["hi", "", "2"] and got[None].roles == ["user", "assistant", "user"] and got[1].loss_text == ""


def test_archives_round_trip(spark):
    body = "é" * 600
    rows = [(1, "u\n", body), (5, None, body), (2, "v", None), (3, "w", "small"), (4, "w", "small"), (None, "n", body)]
    got = {r.page_id: r for r in archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 5, 1200)
    assert got[1].payload_digest == hashlib.sha1(body.encode()).hexdigest()
    assert {k for k, r in got.items() if r.record_type == "response"} == {5, 2, 3, 4, None}
