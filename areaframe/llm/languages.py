"""Language identification of mixed text.

A word is a run of letters of one script. Its script narrows the candidates to the languages
that write in it, its character trigrams and the word itself score them. Viterbi over the words of
a text, with a penalty for every switch, labels spans; the text's language is that of most letters.

The model is counts over all training texts: (language, trigram bucket) and (language, word bucket),
each of a fixed number of buckets, and letters by (language, script).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extend, extended, pieces
from .words import mix

U = np.uint64
#: Ranges of code points by script, as Unicode's charts place them. Letters beyond them are Other.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS) + 1
#: Code points of a word at most: scripts without spaces are cut there.
LONGEST = 16


@dataclass(frozen=True)
class Params:
    """``buckets`` of trigrams and as many of words; ``switch`` is what a change of language costs, in natural logs;
    a script belongs to a language when it holds ``own_script`` of its training letters. ``smooth`` is added to every count."""

    buckets: int = 1 << 16
    switch: float = 8.0
    own_script: float = 0.01
    smooth: float = 0.5
    most_langs: int = 500


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its script, 0 for what is no letter, and its lower case."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x323B0)]:
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            kind[c] = OTHER
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif category[0] == "M":
            kind[c] = 255
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            own = kind[a : b + 1]
            own[own == OTHER] = number
    return kind, lower


@dataclass
class Words:
    """Words of many texts: code points (lower case, 0 between words), spans, script and each text's range."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    bounds: np.ndarray
    text_at: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return self.ends - self.starts


def split_words(data: np.ndarray, marks: np.ndarray) -> Words:
    kind, lower = letters()
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    text_at = begins[marks]
    n = len(raw)
    script = kind[raw]
    # A mark belongs to the letter before it.
    place = np.arange(n)
    marked = script == 255
    before = np.maximum.accumulate(np.where(marked, 0, place)) if n else place
    script = np.where(marked, np.where(script[before] == 255, 0, script[before]), script) if n else script
    change = np.ones(n, bool)
    change[1:] = script[1:] != script[:-1]
    change[text_at[:-1][text_at[:-1] < n]] = True
    run = np.maximum.accumulate(np.where(change, place, 0)) if n else place
    change |= (place - run) % LONGEST == 0
    starts = np.flatnonzero(change)
    ends = np.r_[starts[1:], n].astype(np.int64)[: len(starts)]
    keep = script[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return Words(np.where(script > 0, lower[raw], 0), starts, ends, script[starts], np.searchsorted(starts, text_at), text_at)


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each letter's trigram, nothing standing beyond the word's ends, and one for each word."""
    sizes = words.sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(words.starts - np.cumsum(sizes) + sizes, sizes)
    point = words.points[at].astype(np.uint64)
    first = at == words.starts[owner]
    last = at == words.ends[owner] - 1
    left, right = np.zeros_like(point), np.zeros_like(point)
    left[1:], right[:-1] = point[:-1], point[1:]
    left[first], right[last] = 0, 0
    grams = mix((left << U(42)) | (point << U(21)) | right)
    whole = np.add.reduceat(mix(point + (at - words.starts[owner]).astype(np.uint64) * U(0x1F123BB5)), np.cumsum(sizes) - sizes) if len(sizes) else point
    return (grams % U(buckets)).astype(np.int64), (mix(whole) % U(buckets)).astype(np.int64)


@dataclass
class Model:
    """Log-probabilities by (bucket, language) and which languages a script belongs to."""

    langs: list[str]
    grams: np.ndarray
    words: np.ndarray
    scripts: np.ndarray
    params: Params

    def scores(self, words: Words) -> np.ndarray:
        """Per word and language a log-probability. Languages that do not write in the word's script are out of
        question; a word in a script of no language says nothing."""
        if not len(words.starts):
            return np.zeros((0, len(self.langs)), np.float32)
        grams, whole = features(words, self.params.buckets)
        out = np.add.reduceat(self.grams[grams], np.cumsum(words.sizes) - words.sizes) + self.words[whole]
        own = self.scripts[words.script]
        out = np.where(own, out, out.max(1, keepdims=True) - np.float32(50))
        return np.where(own.any(1)[:, None], out, np.float32(0))


COUNTS = "kind int, lang string, bucket int, n bigint"
GRAM, WORD, SCRIPT = 0, 1, 2


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text", params: Params = Params()) -> Model:
    """Counts over all rows with a language. What reaches the driver is bounded: 2 x buckets + scripts numbers for each language;
    more than ``most_langs`` languages are refused.

    Defined cases: rows without language or text teach nothing; languages whose texts hold no letter are not learnt; an empty
    table gives a model without languages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = params.buckets
        kinds = (buckets, buckets, 256)
        held: dict[str, list[np.ndarray]] = {}
        for rows, data, marks in pieces(batches, "text", 1 << 21):
            words = split_words(data, marks)
            grams, whole = features(words, buckets)
            coded = rows.column(0).dictionary_encode()
            of_text = coded.indices.to_numpy(zero_copy_only=False)
            of_word = np.repeat(of_text, np.diff(words.bounds))
            of_letter = np.repeat(of_word, words.sizes)
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                own = held.setdefault(lang, [np.zeros(k, np.int64) for k in kinds])
                own[GRAM] += np.bincount(grams[of_letter == i], minlength=buckets)
                own[WORD] += np.bincount(whole[of_word == i], minlength=buckets)
                own[SCRIPT] += np.bincount(words.script[of_word == i], words.sizes[of_word == i], 256).astype(np.int64)
        for lang, counts in held.items():
            for kind, own in enumerate(counts):
                some = np.flatnonzero(own)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), kind, np.int32)), pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])],
                        names=["kind", "lang", "bucket", "n"],
                    )

    slim = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = slim.mapInArrow(task, COUNTS).groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    kind, bucket, n = (found.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    listed = found.column("lang").to_pylist()
    langs = sorted(set(listed))
    if len(langs) > params.most_langs:
        raise ValueError(f"{len(langs)} languages, more than {params.most_langs}")
    place = {lang: i for i, lang in enumerate(langs)}
    column = np.fromiter((place[x] for x in listed), np.int64, len(listed))
    tables = []
    for k, size in ((GRAM, params.buckets), (WORD, params.buckets), (SCRIPT, 256)):
        table = np.zeros((size, len(langs)))
        table[bucket[kind == k], column[kind == k]] = n[kind == k]
        tables.append(table)
    logs = [np.log((t + params.smooth) / (t.sum(0) + params.smooth * len(t))).astype(np.float32) for t in tables[:2]]
    own = tables[2] >= params.own_script * np.maximum(1, tables[2].sum(0))
    return Model(langs, *logs, own & (tables[2] > 0), params)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best path of each run of rows: the sum of its scores less ``switch`` for every change. All runs advance
    together, long ones last; ties stay, or take the first language."""
    n, k = scores.shape
    labels = np.zeros(n, np.int32)
    sizes = np.diff(bounds)
    if not n or k < 2:
        return labels
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    came = np.zeros((n, k), np.int32 if k > 127 else np.int8)
    stay = np.arange(k)
    state = scores[starts[: active[0]]].astype(np.float64)
    finals = np.zeros(active[0], np.int64)
    for step in range(1, sizes[0]):
        m = active[step]
        if m < len(state):
            finals[m : len(state)] = state[m:].argmax(1)
            state = state[:m]
        best = state.argmax(1)
        top = state[np.arange(m), best][:, None] - switch
        moved = state < top
        rows = starts[:m] + step
        came[rows] = np.where(moved, best[:, None], stay)
        state = np.where(moved, top, state) + scores[rows]
    finals[: len(state)] = state.argmax(1)
    at = finals
    for step in range(sizes[0] - 1, -1, -1):
        m = active[step]
        rows = starts[:m] + step
        labels[rows] = at[:m]
        at[:m] = came[rows, at[:m]] if step else at[:m]
    return labels


def label(model: Model, data: np.ndarray, marks: np.ndarray) -> tuple[list, np.ndarray, list]:
    """Per text: the language, a score from 0 to 1, and spans (start, end, lang) in code points."""
    words = split_words(data, marks)
    n, k = len(marks) - 1, len(model.langs)
    some = np.diff(words.bounds) > 0
    if not k:
        return [None] * n, np.zeros(n), [[] for _ in range(n)]
    scores = model.scores(words)
    labels = viterbi(scores, words.bounds, model.params.switch)
    of_word = np.repeat(np.arange(n), np.diff(words.bounds))
    weight = np.bincount(of_word * k + labels, words.sizes, n * k).reshape(n, k)
    best = weight.argmax(1)
    # The share of letters that, word by word, speak for the text's language.
    powers = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    chance = powers[np.arange(len(labels)), best[of_word]] / powers.sum(1) if len(scores) else np.zeros(0)
    sure = np.bincount(of_word, chance * words.sizes, n) / np.maximum(1, np.bincount(of_word, words.sizes, n))
    edge = np.ones(len(labels), bool)
    edge[1:] = (labels[1:] != labels[:-1]) | (of_word[1:] != of_word[:-1])
    first = np.flatnonzero(edge)
    last = np.r_[first[1:], len(labels)].astype(np.int64)[: len(first)] - 1
    base = words.text_at[of_word[first]]
    spans: list[list] = [[] for _ in range(n)]
    for i, a, b, l in zip(of_word[first].tolist(), (words.starts[first] - base).tolist(), (words.ends[last] - base).tolist(), labels[first].tolist()):
        spans[i].append({"start": a, "end": b, "lang": model.langs[l]})
    return [model.langs[b] if s else None for b, s in zip(best.tolist(), some.tolist())], np.where(some, np.minimum(sure, 1), 0.0), spans


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """Adds ``lang_pred`` ('und' where the text is null or has no letter), ``score`` (0 to 1) and, where asked for, ``spans``, an array of
    (start, end, lang) in characters from the first to the last letter of each span.

    Defined cases: a text in a script of no learnt language still gets the first language that ties; a model without languages
    predicts 'und' everywhere. Equal weights go to the language that sorts first. Texts are read whole; a text's
    words are labelled in sequence, so one text costs time by its words. Repeated rows get equal
    results; an own column of a result's name gives way to it; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": "string", "score": "double", **({"spans": "array<struct<start:bigint,end:bigint,lang:string>>"} if spans else {})}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, marks in pieces(batches, text_col, 1 << 21):
            langs, score, found = label(own, data, marks)
            new = {"lang_pred": pa.array([x or "und" for x in langs], pa.string()), "score": pa.array(score, pa.float64())}
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                new["spans"] = pa.array(found, kind)
            yield extend(rows, new)

    return docs.mapInArrow(task, extended(docs, added))
