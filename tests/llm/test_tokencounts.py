import random
from collections import Counter

import pytest

from areaframe.llm.tokencounts import Encoder, load_ranks, section_tokens

TEXTS = [
    None, "", "\n", "\n\n\n a", "one line", "Hello  wörld\n日本語 \U0001f600\U0001f468‍\U0001f469\nend", "a\r\n\tb\n",
    "x" * 4000, "né \U0001f9ff\n\U0001f9ff" * 40, "word " * 900,
]


def tokens(coder, text):
    """Per token the characters that its bytes belong to."""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for token in coder.coder.encode(text, disallowed_special=()):
        size = len(coder.coder.decode_single_token_bytes(token))
        yield sorted(set(owner[at : at + size]))
        at += size
    assert at == len(owner)


def plain(coder, text, sections, rule):
    """section (None: outside) -> [tokens, crossing]; an earlier section has what two hold."""
    text, holder = text or "", {}
    for start, end, name in sorted(sections):
        for i in range(max(0, start), min(end, len(text))):
            holder.setdefault(i, name)
    out = {name: [0, 0] for _, _, name in sections}
    for chars in tokens(coder, text):
        shares = Counter(holder.get(i) for i in chars)
        order = [n for n in dict.fromkeys(holder.get(i) for i in chars) if n is not None] + [None]
        if len(shares) > 1:
            for name in shares:
                out.setdefault(name, [0, 0])[1] += 1
        if rule == "share":
            for name, n in shares.items():
                out.setdefault(name, [0, 0])[0] += n / len(chars)
        elif rule == "most":
            out.setdefault(max(order, key=lambda n: shares.get(n, 0)), [0, 0])[0] += 1
        else:
            out.setdefault(holder.get(chars[0]), [0, 0])[0] += 1
    return out


def lines(text):
    out, at = [], 0
    for i, line in enumerate((text or "").split("\n")):
        out.append((at, at + len(line) + 1, i))
        at += len(line) + 1
    return out


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, {})[r.section] = [r.n_tokens, r.n_crossing]
    return out


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_equals_token_by_token(spark, rule):
    coder, rng = Encoder(load_ranks()), random.Random(3)
    docs = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id int, text string, n_tokens int")
    got = listed(section_tokens(frame, rule=rule))
    for i, text in docs:
        expected = plain(coder, text, lines(text), rule)
        mine = {k: v for k, v in got[i].items() if v != [0, 0]}
        assert mine == {k: pytest.approx(v) for k, v in expected.items() if v != [0, 0]}
    cut = {i: [(a, a + rng.randint(1, 9), k) for k, a in enumerate(rng.sample(range(-3, 60), 9))] for i, _ in docs}
    rows = [(i, k, a, b) for i, spans in cut.items() for a, b, k in spans] + [(4, 77, None, 3), (4, 78, 5, 2), (99, 1, 0, 5)]
    sections = spark.createDataFrame(rows, "doc_id int, section int, start int, end int")
    got = listed(section_tokens(frame, sections, rule=rule))
    for i, text in docs:
        expected = plain(coder, text, cut[i], rule)
        mine = {k: v for k, v in got[i].items() if v != [0, 0]}
        assert mine == {k: pytest.approx(v) for k, v in expected.items() if v != [0, 0]}


def test_repeated_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id int, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in section_tokens(frame).collect()) == [("1", 2), ("1", 2), ("None", 1)]
    assert section_tokens(frame.limit(0)).collect() == []
