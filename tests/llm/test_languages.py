import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from areaframe.llm.languages import Model, Params, features, identify, label, learn, letters, split_words, viterbi
from areaframe.llm.shared import texts

WORDS = {
    "en": "the of and with house shall which other thing water",
    "de": "der und nicht schön auch straße haus werden über wasser",
    "ru": "это дом вода который другой будет",
    "el": "το σπίτι νερό άλλο πράγμα",
}


def sentence(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def corpus(n=200):
    rng = random.Random(0)
    return [(i, sentence(rng, lang, rng.randint(1, 30)), lang) for i in range(n) for lang in [rng.choice([*WORDS])]]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 0, 6, 5, 2, 6]
    bounds = np.r_[0, np.cumsum(sizes)]
    for k, switch in ((2, 0.7), (3, 1.5), (3, 0.0)):
        scores = rng.normal(size=(bounds[-1], k)).astype(np.float32)
        got = viterbi(scores, bounds, switch)
        for a, b in zip(bounds, bounds[1:]):
            def worth(path):
                return sum(scores[a + i, x] for i, x in enumerate(path)) - switch * sum(x != y for x, y in zip(path, path[1:]))
            best = max((worth(p) for p in itertools.product(range(k), repeat=b - a)), default=0)
            assert abs(worth(got[a:b].tolist()) - best) < 1e-5


def test_words_of_one_script():
    data, marks = texts(pa.array(["Ab-cd", "жzé", None, "", "12", "日本語" * 9, "é x", "ต้น"]))
    words = split_words(data, marks)
    spelled = ["".join(map(chr, words.points[a:b])) for a, b in zip(words.starts, words.ends)]
    runs = [spelled[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
    assert runs == [["ab", "cd"], ["ж", "zé"], [], [], [], ["日本語" * 5 + "日", "本語" + "日本語" * 3], ["é", "x"], ["ต้น"]]
    assert letters()[0][ord("ß")] == 1 and letters()[0][ord("1")] == 0
    # Equal words have equal features wherever they stand.
    grams, whole = features(split_words(*texts(pa.array(["water wine", "x water"]))), 1 << 16)
    assert (grams[:5] == grams[-5:]).all() and whole[0] == whole[-1] and whole[0] != whole[1]


def test_spans_of_mixed_text(spark):
    docs = corpus()
    model = learn(spark.createDataFrame([*docs, (0, None, "xx"), (0, "12 ?", "yy"), (0, "word", None)], "doc_id int, text string, lang string"))
    assert model.langs == ["de", "el", "en", "ru"]
    rng = random.Random(1)
    parts = [(lang, sentence(rng, lang, 12)) for lang in ("en", "de", "ru", "en", "el")]
    text = ". ".join(p for _, p in parts)
    frame = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (2, None, "a", 1), (3, "", "a", 1), (4, "12 !?", "a", 1), (5, "日本", "a", 1), (6, "Straße " * 30_000, "a", 1)],
                                  "doc_id int, text string, lang_pred string, score int")
    got = identify(frame, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id == 1] == ["en"] * 2
    spans = by[1].spans
    assert [s.lang for s in spans] == [lang for lang, _ in parts]
    assert [text[s.start : s.end] for s in spans] == [p for _, p in parts]
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[4].score == 0 and by[2].spans == []
    assert by[5].lang_pred in model.langs and by[6].lang_pred == "de" and 0.9 < by[6].score <= 1
    assert identify(frame.limit(0), model).collect() == []
    nothing = learn(frame.limit(0).selectExpr("text", "'a' AS lang"))
    assert {r.lang_pred for r in identify(frame, nothing, spans=False).collect()} == {"und"}


def test_scripts_narrow_candidates():
    params = Params(buckets=64)
    model = Model(["a", "b"], np.zeros((64, 2), np.float32), np.zeros((64, 2), np.float32), np.zeros((256, 2), bool), params)
    model.scripts[1, 0] = model.scripts[3, 1] = True  # a in Latin, b in Cyrillic
    langs, score, spans = label(model, *texts(pa.array(["abc abc", "дом", "abc дом дом дом", "日"])))
    assert langs == ["a", "b", "b", "a"] and [len(s) for s in spans] == [1, 1, 2, 1] and (0 <= score).all() and (score <= 1).all()


def test_held_out_accuracy_of_the_query(spark, small):
    from areaframe.llm.queries import QUERIES, table

    known = {r.doc_id: (r.lang, r.text) for r in table(spark, small, "documents").collect()}
    rows = QUERIES["op13_language_id"](spark, small).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and any(c.isalpha() for c in known[r.doc_id][1] or "")]
    right = sum(r.lang_pred == known[r.doc_id][0] for r in judged)
    assert right / len(judged) > 0.95, right / len(judged)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in known[r.doc_id][1] or "")) for r in rows)
