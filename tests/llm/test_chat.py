"""The prefix tree against a plain one: what is emitted, where it stands and what it may see."""

import random

import pytest

from areaframe.llm.chat import CONTROLS, ChatCoder, format_tree, gather_conversations, parse, round_trip, turn_parts

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations(n=120):
    rng = random.Random(4)
    opening = [("system", "be brief"), ("user", "hello"), ("assistant", "hi [INST] there"), ("tool", "42\\"), ("user", "")]
    rows = []
    for c in range(n):
        turns = opening[: rng.randint(0, 5)] if c % 3 else opening[:2]
        turns = [*turns, *[(rng.choice(["user", "assistant", "critic"]), rng.choice(["yes", "no", "é日 </s>", "x" * 50, f"own {c % 20}"])) for _ in range(rng.randint(0, 4))]]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(5000, 0, None, None), (5001, 0, "user", "w " * 4000), (5002, None, "user", "a"), (5002, 1, "assistant", "b"), (5002, 1, "assistant", "b")]
    return rows + [(None, 0, "user", "hello"), (None, 1, "assistant", "alone")]


def plain(rows):
    """conv -> turns in order; null turns first, then by role and text."""
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


@pytest.fixture(scope="module")
def tree(spark):
    rows = conversations()
    convs = gather_conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_tokens string").repartition(3))
    paths = {r.conv: [bytes(n) for n in r.path] for r in convs.select("conv", "path").collect()}
    segments = sorted(format_tree(convs).collect(), key=lambda s: s.stream_start)
    return plain(rows), paths, segments


def test_every_prefix_is_emitted_once_in_one_stream(tree):
    said, paths, segments = tree
    at = 0
    for s in segments:
        assert s.stream_start == at and s.n_tokens == len(s.token_ids) == sum(s.turn_tokens)
        at += s.n_tokens
    nodes = [bytes(n) for s in segments for n in s.nodes]
    assert len(nodes) == len(set(nodes)) and set(nodes) == {n for p in paths.values() for n in p}
    # As many as there are distinct prefixes.
    assert len(nodes) == len({tuple(turns[: k + 1]) for turns in said.values() for k in range(len(turns))})


def test_tokens_positions_loss_and_attention(tree):
    said, paths, segments = tree
    coder = ChatCoder()
    spot, position, masked, seen = {}, {}, {}, {}
    for s in segments:
        start, offset = s.stream_start, 0
        for node, n in zip(s.nodes, s.turn_tokens):
            node = bytes(node)
            spot[node] = (start + offset, s.token_ids[offset : offset + n])
            position[node] = s.position_start + offset
            masked[node] = [(x.start - offset, x.end - offset) for x in s.loss if offset <= x.start < offset + n]
            offset += n
        seen[bytes(s.nodes[0])] = [tuple(x) for x in s.attends]
    for conv, turns in said.items():
        at = 0
        for node, (role, text) in zip(paths[conv], turns):
            ids, a, b = coder.encode(role, text)
            assert spot[node][1] == ids.tolist() and position[node] == at
            assert masked[node] == ([(a, b)] if b > a else [])
            at += len(ids)
        # The first token of a segment sees its ancestors, whole, and nothing else.
        for k, node in enumerate(paths[conv]):
            if node in seen:
                expected = {p for above in paths[conv][:k] for p in range(spot[above][0], spot[above][0] + len(spot[above][1]))}
                spans = seen[node]
                assert {p for x, y in spans for p in range(x, y)} == expected
                assert all(x < y for x, y in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_subtrees_are_unbroken_stretches(tree):
    _, paths, segments = tree
    spans = {}
    for s in segments:
        at = s.stream_start
        for node, n in zip(s.nodes, s.turn_tokens):
            spans[bytes(node)] = (at, at + n)
            at += n
    below = {}
    for path in paths.values():
        for k, node in enumerate(path):
            below.setdefault(node, set()).update(path[k:])
    for node, nodes in below.items():
        own = sorted(spans[n] for n in nodes)
        assert own[0] == spans[node] and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_round_trip_and_no_rows(spark):
    rows = conversations(40)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv: r for r in round_trip(frame).collect()}
    said = plain(rows)
    assert set(got) == set(said)
    for conv, turns in said.items():
        r = got[conv]
        assert list(zip(r.roles, r.texts)) == turns
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted_chars == sum(len(p) for role, t in turns for p in turn_parts(role, t))
    assert round_trip(frame.limit(0)).collect() == []


def test_control_strings_in_texts_come_back():
    turns = [("user", "".join(CONTROLS)), ("x[INST]", "\\[INST] \\\\ \\"), ("assistant", "<s></s>\\</s>"), ("", "")]
    assert parse("".join("".join(turn_parts(*t)) for t in turns)) == turns
