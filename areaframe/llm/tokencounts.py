"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once; every token's span of characters follows from the lengths of
the tokens. Spans are joined to sections by interval, and a token that crosses a boundary
goes where the rule says: ``start`` (the section of its first character), ``most`` (the
section with most of its characters, ties to the earlier) or ``share`` (to each by its
part of the characters).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces
from .words import code_points, line_spans

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "most", "share")
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(2)
def _encoding(items: tuple, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(items), special_tokens={})


class Encoder:
    """A byte-level BPE that also tells how many bytes each token spells."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    @property
    def coder(self):
        if self._made is None:
            self._made = _encoding(tuple(self.ranks.items()), self.pattern)
        return self._made

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


def allocate(
    first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many tokens that cross its borders it got a part of.

    ``first``, ``last``: character spans of tokens, in order. ``starts``, ``ends``: sections in
    order of start; where they overlap the earlier has the characters. The last entry of both
    results is for tokens outside every section.
    """
    n = len(starts)
    counts, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if n:
        reach = np.maximum.accumulate(np.maximum(ends, starts))
        starts = np.maximum(starts, np.r_[0, reach[:-1]])
        ends = np.maximum(reach, starts)
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(starts, last, "left")
    inside = (high - low == 1)
    at = np.minimum(low, max(0, n - 1))
    if n:
        inside &= (starts[at] <= first) & (last <= ends[at])
    np.add.at(counts, at[inside], 1)
    outside = high <= low
    counts[n] += outside.sum()
    for i in np.flatnonzero(~inside & ~outside).tolist():
        span = np.arange(low[i], high[i])
        share = np.minimum(ends[span], last[i]) - np.maximum(starts[span], first[i])
        span, share = span[share > 0], share[share > 0]
        rest = last[i] - first[i] - share.sum()
        where = np.r_[span, n] if rest > 0 else span
        share = np.r_[share, rest] if rest > 0 else share
        crossing[where] += 1
        if rule == "share":
            counts[where] += share / share.sum()
        elif rule == "most":
            counts[where[share.argmax()]] += 1
        else:
            held = span[(starts[span] <= first[i]) & (first[i] < ends[span])]
            counts[held[0] if len(held) else n] += 1
    return counts, crossing


def section_tokens(
    docs: DataFrame, sections: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    rule: str = "most", path: str = RANKS,
) -> DataFrame:
    """Per document and section: ``section``, ``start``, ``end`` (characters), ``n_tokens`` and ``n_crossing``.

    ``sections`` has ``id_col``, section, start, end; without it the lines of the text are the
    sections, each with the line feed that ends it. Tokens outside every section are on a
    row whose section, start and end are null, so a document's rows always sum to its
    tokens; that row is there where it counts something or is the only one.

    Defined cases: a null or empty text has no tokens and one row of 0. Sections that are null,
    turned round or beyond the text hold nothing. Rows that share an id are attributed each by
    its own text, with the id's sections. Other columns are not read; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own = Encoder(load_ranks(path))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given = sections is not None
    if given:
        listed = (
            sections.filter('`start` IS NOT NULL AND `end` > `start`')
            .groupBy(F.col(id_col).alias("_id"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("section").cast("bigint").alias("section")))).alias("spans"))
        )
        slim = slim.join(listed, F.col("id") == F.col("_id"), "left").select("id", "text", "spans")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, marks in pieces(batches, "text", 1 << 20):
            points = code_points(data)
            a, b, bounds = line_spans(data, marks)
            whole = data.tobytes()
            out = [[] for _ in range(6)]
            for i, (s, e) in enumerate(zip(marks[:-1].tolist(), marks[1:].tolist())):
                ids = own.encode(whole[s:e].decode())
                stops = s + np.cumsum(own.sizes[ids])
                begins = stops - own.sizes[ids]
                base = points[s]
                # A token that begins or ends inside a character covers that character.
                first, last = points[begins + 1] - 1 - base, points[stops] - base
                if given:
                    spans = rows.column(2)[i].as_py() or []
                    starts, ends, names = (np.array([x[k] for x in spans], np.int64) for k in ("start", "end", "section"))
                    ends = np.minimum(ends, points[e] - base)
                    starts = np.minimum(np.maximum(starts, 0), ends)
                else:
                    cut = slice(bounds[i], bounds[i + 1])
                    starts = points[a[cut]] - base
                    ends = np.r_[starts[1:], points[e] - base]
                    names = np.arange(len(starts))
                counts, crossing = allocate(first, last, starts, ends, rule)
                n = len(starts)
                take = n + 1 if counts[n] or crossing[n] or n == 0 else n
                nothing = [None] * (take - n)
                out[0].append(np.full(take, i))
                for column, values in zip(out[1:4], (names, starts, ends)):
                    column.extend([*values.tolist(), *nothing])
                out[4].append(counts[:take])
                out[5].append(crossing[:take])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(np.concatenate(out[0]))),
                 *[pa.array(c, pa.int64()) for c in out[1:4]],
                 pa.array(np.concatenate(out[4])), pa.array(np.concatenate(out[5]))],
                names=["id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    long = slim.mapInArrow(task, f"id {kind}, section bigint, start bigint, end bigint, n_tokens double, n_crossing bigint")
    number = F.col("n_tokens") if rule == "share" else F.col("n_tokens").cast("bigint")
    return long.select(F.col("id").alias(id_col), "section", "start", "end", number.alias("n_tokens"), "n_crossing")
