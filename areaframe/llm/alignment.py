"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a SentencePiece
model with byte fallback (B).

Both read a space and the text. A's character offsets and B's spans are the coarse cuts; where a
token holds a part of a character only, or is a byte of the fallback, its end follows from
its decoded bytes. Byte offsets at which tokens of both end cut a text into groups; tokens
whose bytes overlap are links.

Neither tokenizer joins anything over the step from a character that is no space to a single
space that follows, so a run of documents (a block) is cut there, and every distinct segment of the block is
encoded and aligned once. A block writes its documents as numbers of segments, the segments' tokens once, and the
pairs of ids that it links, with the number of documents that hold each. These counts are
summed over all blocks, joined back to each block's distinct pairs and applied to its segments.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pieces, save, texts

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a block, distinct segments encoded at once, segments in a text, and segments remembered.
BLOCK, BATCH, RUN, KNOWN = 1 << 22, 1 << 12, 64, 1 << 18
DOCUMENT, SEGMENTS, PAIR = 0, 1, 2


def byte_letters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 characters
    stand for themselves, the others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """What a piece of B spells: U+2581 is a space, <0xHH> a byte."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Spelled:
    """The bytes of every id, end to end."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.data = np.frombuffer(b"".join(table) or b"\0", np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.starts[ids], self.sizes[ids])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of many runs, one run after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)


class Pair:
    """Both tokenizers, loaded where they are used."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, size = byte_letters(), self.a.get_vocab_size(with_added_tokens=True)
        table = [self.a.id_to_token(i) or "" for i in range(size)]
        self.spelled_a = Spelled([bytes(letters[c] for c in t) if set(t) <= set(letters) else t.encode() for t in table])
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelled_b = Spelled([piece_bytes(p) for p in spelled])
        #: Segments met before, and their tokens.
        self.known: tuple[pa.Array, Aligned] | None = None
        #: Whether no piece reaches over the step from another character to a space.
        self.separable = not any(re.search("[^▁ ][▁ ]", p) for p in spelled)

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Texts that begin with a space. For A and B: tokens per text, ids, first and last character of each."""
        out = []
        found = self.a.encode_batch(texts, add_special_tokens=False)
        out.append(flat([x.ids for x in found], [x.offsets for x in found]))
        found = self.b.encode([x[1:] for x in texts], num_threads=1, return_type="offset_mapping")
        sizes, ids, firsts, lasts = flat([x["ids"] for x in found], [x["offsets"] for x in found])
        # B's own space is not in its offsets: everything moves by one, the first token begins at it.
        firsts, lasts = firsts + 1, lasts + 1
        first_of = np.cumsum(sizes) - sizes
        firsts[first_of[sizes > 0]] = 0
        out.append((sizes, ids, firsts, lasts))
        return out[0], out[1]


def flat(ids: list[list[int]], offsets: list[list[tuple[int, int]]]) -> tuple[np.ndarray, ...]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    n, every = int(sizes.sum()), chain.from_iterable
    spans = np.fromiter(every(every(offsets)), np.int64, 2 * n).reshape(n, 2)
    return sizes, np.fromiter(every(ids), np.int32, n), spans[:, 0].copy(), spans[:, 1].copy()


@lru_cache(2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def surely_solid(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each place is no space of any kind. Characters that begin with the bytes
    of wide spaces are not sure."""
    one, two, three = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    ascii_ = (one > 0x20) & (one < 0x7F)
    wide = (one >= 0x80) & (two != 0xC2) & ~(((three & 0xF0) == 0xE0) & (three <= 0xE3) & ((two & 0xC0) == 0x80))
    return ascii_ | wide


def cuts(whole: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where segments begin: at every text, and at a space that follows a character that is surely none
    and does not end its text."""
    at = np.flatnonzero(whole == 0x20)
    last = np.zeros(len(whole) + 1, bool)
    last[marks[1:] - 1] = True
    own = np.zeros(len(whole) + 1, bool)
    own[at[surely_solid(whole, at) & ~last[at]]] = True
    own[marks[:-1]] = True
    return np.flatnonzero(own[: len(whole)])


def refined(ids: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, text_of: np.ndarray, spelled: Spelled,
            byte_at: np.ndarray, char_base: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The byte at which each token ends, counted from its text's begin. The coarse cut holds where the span spells as many
    bytes as the token; from there on, the decoded bytes tell."""
    n = len(ids)
    sums = np.r_[0, np.cumsum(spelled.sizes[ids])]
    here = char_base[text_of]
    limit = char_base[text_of + 1]
    first, last = (byte_at[np.minimum(here + x, limit)] for x in (firsts, lasts))
    exact = last - first == spelled.sizes[ids]
    place = np.arange(n)
    begins = np.searchsorted(text_of, np.arange(len(base)))
    anchor = np.maximum.accumulate(np.where(exact, place, -1)) if n else place
    starts = begins[text_of]
    known = anchor >= starts
    anchor = np.where(known, anchor, 0)
    before = np.where(known, last[anchor] - base[text_of], 0) if n else place
    since = np.where(known, sums[1:][anchor], sums[starts]) if n else place
    return before + sums[1:] - since


@dataclass
class Aligned:
    """Distinct segments. Ragged arrays carry their sizes per segment."""

    whole: np.ndarray
    sizes_a: np.ndarray
    ids_a: np.ndarray
    sizes_b: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray

    @property
    def segment_a(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes_a)), self.sizes_a)

    @property
    def segment_b(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes_b)), self.sizes_b)

    def take(self, at: np.ndarray) -> Aligned:
        """The segments at these places, in this order."""
        first_a, first_b = np.cumsum(self.sizes_a) - self.sizes_a, np.cumsum(self.sizes_b) - self.sizes_b
        a, b = spread(first_a[at], self.sizes_a[at]), spread(first_b[at], self.sizes_b[at])
        return Aligned(self.whole[at], self.sizes_a[at], self.ids_a[a], self.sizes_b[at], self.ids_b[b], self.ends_a[a], self.ends_b[b])

    def and_then(self, more: Aligned) -> Aligned:
        names = ("whole", "sizes_a", "ids_a", "sizes_b", "ids_b", "ends_a", "ends_b")
        return Aligned(*[np.concatenate([getattr(self, n), getattr(more, n)]) for n in names])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of A and of B as one growing number over all segments, and those common to both."""
        reach = int(max([0, *self.ends_a[-1:], self.ends_a.max(initial=0), self.ends_b.max(initial=0)])) + 1
        a, b = self.segment_a * reach + self.ends_a, self.segment_b * reach + self.ends_b
        return a, b, a[np.isin(a, b, assume_unique=True, kind="sort")]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links as A's id * 2**32 + B's id, in order, and how many each segment has."""
        a, b, _ = self.keys()
        union = distinct(np.r_[a, b])
        at_a, at_b = np.searchsorted(a, union), np.searchsorted(b, union)
        pairs = (self.ids_a[at_a].astype(np.int64) << 32) | self.ids_b[at_b].astype(np.int64)
        return pairs, np.bincount(self.segment_a[at_a], minlength=len(self.sizes_a))

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups per segment; and all of them."""
        a, _, both = self.keys()
        return np.bincount(self.segment_a[np.searchsorted(a, both)], minlength=len(self.sizes_a)), both

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2;`` of all segments, end to end, and the bytes of each."""
        a, b, both = self.keys()
        group_a, group_b = np.searchsorted(both, a), np.searchsorted(both, b)
        n = len(a) + len(b)
        ids, marks, owner = np.empty(n, np.int64), np.empty(n, np.uint8), np.empty(n, np.int64)
        # A token stands behind the other side's tokens of earlier groups, B's also behind A's of its own.
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        for place, own, group, close, segment in (
            (place_a, self.ids_a, group_a, ord("|"), self.segment_a), (place_b, self.ids_b, group_b, ord(";"), self.segment_b),
        ):
            ids[place], owner[place] = own, segment
            ends = np.ones(len(own), bool)
            ends[:-1] = group[1:] != group[:-1]
            marks[place] = np.where(ends, close, ord(","))
        digits = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
        width = int(digits.max(initial=1)) + 1
        out = np.zeros((n, width), np.uint8)
        rest = ids.copy()
        for k in range(width - 1):
            out[:, width - 2 - k] = 48 + rest % 10
            rest //= 10
        out[:, width - 1] = marks
        keep = np.arange(width) >= (width - 1 - digits)[:, None]
        return out[keep], np.bincount(owner, digits + 1, len(self.sizes_a)).astype(np.int64)


def encode_runs(own: Pair, data: np.ndarray, marks: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Segments (``marks`` in ``data``) encoded as texts of one or more, a text beginning where ``new`` says. Per segment whether its
    text comes back byte by byte from both sides; per side and token the segment, the id and the end within the segment."""
    first = np.flatnonzero(new)
    edge = np.r_[marks[:-1][first], marks[-1]]
    whole = data.tobytes()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    byte_at = np.r_[begins, len(data)]
    char_base = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    good, sides = np.ones(len(texts), bool), []
    for (sizes, ids, firsts, lasts), spelled in zip(own.encode(texts), (own.spelled_a, own.spelled_b)):
        text_of = np.repeat(np.arange(len(texts)), sizes)
        got = np.bincount(text_of, spelled.sizes[ids], len(texts)).astype(np.int64)
        same = got == np.diff(edge)
        # Equal lengths are not enough: the bytes themselves are compared.
        mine = spelled.join(ids[same[text_of]])
        theirs = data[spread(edge[:-1][same], np.diff(edge)[same])]
        good &= same & (np.bincount(np.repeat(np.flatnonzero(same), np.diff(edge)[same]), mine != theirs, len(texts)) == 0)
        ends = edge[:-1][text_of] + refined(ids, firsts, lasts, text_of, spelled, byte_at, char_base, edge[:-1])
        sides.append((text_of, ids, ends))
    out = []
    for text_of, ids, ends in sides:
        kept = good[text_of]
        segment = np.searchsorted(marks, ends[kept]) - 1
        out.append((segment, ids[kept], ends[kept] - marks[segment]))
    return good[np.cumsum(new) - 1], out


def align_segments(own: Pair, segments: pa.Array) -> Aligned:
    """Encodes each segment once by both, many in one text where they can be told apart again. A segment whose bytes either
    side does not give back is not ``whole`` and has no tokens."""
    parts: list[list[np.ndarray]] = [[] for _ in range(7)]
    for start in range(0, len(segments), BATCH):
        data, marks = texts(segments.slice(start, BATCH))
        n = len(marks) - 1
        new = np.ones(n, bool)
        if own.separable:
            new[1:] = ~surely_solid(data, marks[1:-1]) | (np.arange(1, n) % RUN == 0)
        good, sides = encode_runs(own, data, marks, new)
        alone = np.flatnonzero(~good)
        if len(alone):  # one by one, so that a segment that does not come back spoils no other
            sizes = np.diff(marks)[alone]
            fine, more = encode_runs(own, data[spread(marks[alone], sizes)], np.r_[0, np.cumsum(sizes)], np.ones(len(alone), bool))
            good[alone[fine]] = True
            both = [tuple(np.concatenate(x) for x in zip(a, (alone[b[0]], *b[1:]))) for a, b in zip(sides, more)]
            sides = [tuple(x[np.argsort(side[0], kind="stable")] for x in side) for side in both]
        parts[0].append(good)
        for k, (segment, ids, ends) in enumerate(sides):
            parts[1 + 3 * k].append(np.bincount(segment, minlength=n))
            parts[2 + 3 * k].append(ids)
            parts[3 + 3 * k].append(ends)
    whole, sizes_a, ids_a, ends_a, sizes_b, ids_b, ends_b = (
        np.concatenate(p) if p else np.zeros(0, bool if k == 0 else np.int64) for k, p in enumerate(parts)
    )
    return Aligned(whole, sizes_a, ids_a, sizes_b, ids_b, ends_a, ends_b)


def align_known(own: Pair, segments: pa.Array) -> Aligned:
    """As :func:`align_segments`; those met in the blocks before are taken from there. What is held stays below
    ``KNOWN`` segments, or one block's."""
    if own.known is None:
        found = align_segments(own, segments)
        own.known = segments, found
        return found
    held, before = own.known
    at = pc.index_in(segments, value_set=held).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.flatnonzero(at < 0)
    fresh = segments.take(pa.array(new))
    every = before.and_then(align_segments(own, fresh))
    at[new] = len(held) + np.arange(len(new))
    found = every.take(at)
    own.known = (pa.concat_arrays([held, fresh]), every) if len(held) + len(new) <= KNOWN else (segments, found)
    return found


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``."""
    total = np.r_[0, np.cumsum(values)]
    return total[bounds[1:]] - total[bounds[:-1]]


def block_rows(own: Pair, data: np.ndarray, marks: np.ndarray) -> dict[str, object]:
    """One run of texts: per text its segments; the distinct segments; linked pairs with their documents."""
    n = len(marks) - 1
    filled = np.diff(marks) > 0
    # A space goes before each text that is not empty.
    new = np.zeros(n + 1, np.int64)
    np.cumsum(np.diff(marks) + filled, out=new[1:])
    whole = np.full(new[-1], 0x20, np.uint8)
    inside = np.ones(new[-1], bool)
    inside[new[:-1][filled]] = False
    whole[inside] = data
    begins = cuts(whole, new[np.r_[filled, True]]) if own.separable else new[:-1][filled]
    offsets = np.r_[begins, len(whole)].astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
    coded = array.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.searchsorted(begins, new)
    aligned = align_known(own, coded.dictionary)
    valid = filled & (sums(~aligned.whole[codes], bounds) == 0)
    doc_of = np.repeat(np.arange(n), np.diff(bounds))
    kept = valid[doc_of]
    pairs, n_links = aligned.links()
    kinds = distinct(pairs)
    pair_codes = np.searchsorted(kinds, pairs)
    link_at = np.r_[0, np.cumsum(n_links)]
    # Documents that hold a pair: distinct segments of a document first, then distinct pairs of those.
    span = max(1, len(aligned.whole))
    held = distinct(doc_of[kept] * span + codes[kept])
    n_docs = np.zeros(len(kinds), np.int64)
    edges = np.searchsorted(held, np.arange(0, n + 1) * span)
    first = 0
    while first < n:  # a few million links at a time
        links_upto = np.r_[0, np.cumsum(n_links[held[edges[first] :] % span])] if first == 0 else links_upto
        done = links_upto[edges[first] - edges[0]]
        stop = int(np.searchsorted(links_upto[edges - edges[0]], done + (1 << 19), "right")) - 1
        stop = min(max(stop, first + 1), n)
        some = held[edges[first] : edges[stop]]
        segment = some % span
        mine = pair_codes[spread(link_at[segment], n_links[segment])]
        owner = np.repeat(some // span, n_links[segment])
        seen = distinct((owner - first) * max(1, len(kinds)) + mine)
        n_docs += np.bincount(seen % max(1, len(kinds)), minlength=len(kinds))
        first = stop
    used = n_docs > 0
    n_groups, _ = aligned.groups()
    counted = {
        name: np.where(valid, sums(values[codes], bounds), 0)
        for name, values in (("n_a", aligned.sizes_a), ("n_b", aligned.sizes_b), ("n_groups", n_groups), ("n_links", n_links))
    }
    return {
        "codes": [packed(codes[a:b]) if v else b"" for a, b, v in zip(bounds[:-1].tolist(), bounds[1:].tolist(), valid.tolist())],
        "counted": counted, "aligned": aligned, "pairs": kinds[used], "n_docs": n_docs[used],
    }


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, then the next: high bytes are nearly all 0 and compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


FIELDS = "block bigint, kind int, codes binary, tokens array<binary>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, a int, b int, docs bigint"


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE
) -> DataFrame:
    """Per document ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``.

    ``groups`` lists the ids between common ends, ``a1,a2|b1;a3|b2,b3``. A pair of ids counts the documents of the table that
    hold it linked; ``count_sum`` adds the counts of all links, ``n_best`` counts the links whose count is the highest that
    their A id has, ties included.

    Defined cases: a text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens:
    zeros and ''. Texts are read whole; a text never shares a block's segments with another's bytes. Rows that repeat, or share an
    id, count as documents of their own. Ties of counts are all best. Other columns are not read; an empty table gives none.
    A text's groups must fit into one value of Spark (2 GB, some 300 MB of text).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = load(path_a, path_b), TaskContext.get().partitionId()
        schema = None
        for number, (rows, data, marks) in enumerate(pieces(batches, "text", BLOCK)):
            found = block_rows(own, data, marks)
            ids, aligned = rows.column(0), found["aligned"]
            schema = schema or pa.schema(
                [("id", ids.type), ("block", pa.int64()), ("kind", pa.int32()), ("codes", pa.binary()), ("tokens", pa.list_(pa.binary())),
                 *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())]
            )
            block = (part << 32) + number

            def batch(n: int, what: int, schema=schema, block=block, **columns) -> pa.RecordBatch:
                columns |= {"block": pa.array(np.full(n, block)), "kind": pa.array(np.full(n, what, np.int32))}
                return pa.RecordBatch.from_arrays(
                    [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
                )

            yield batch(rows.num_rows, DOCUMENT, id=ids, codes=pa.array(found["codes"], pa.binary()), **{k: pa.array(v) for k, v in found["counted"].items()})
            tokens = [packed(x) for x in (aligned.whole, aligned.sizes_a, aligned.ids_a, aligned.ends_a, aligned.sizes_b, aligned.ids_b, aligned.ends_b)]
            yield batch(1, SEGMENTS, tokens=pa.array([tokens], pa.list_(pa.binary())))
            for start in range(0, len(found["pairs"]), 1 << 16):
                own_pairs, n_docs = (found[k][start : start + (1 << 16)] for k in ("pairs", "n_docs"))
                yield batch(len(n_docs), PAIR, a=pa.array((own_pairs >> 32).astype(np.int32)), b=pa.array((own_pairs & 0xFFFFFFFF).astype(np.int32)), docs=pa.array(n_docs))

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = save(slim.mapInArrow(read, f"id {kind}, {FIELDS}"), "aligned")
    held = blocks.filter(F.col("kind") == PAIR).select("block", "a", "b", "docs")
    counts = held.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    # At most as many rows per A id as B has ids.
    best = F.max("n").over(Window.partitionBy("a"))
    counts = save(counts.withColumn("best", F.col("n") == best), "pairs")
    known = held.select("block", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "a", "b", "n", "best")
    stored = blocks.filter(F.col("kind") != PAIR).drop("a", "b", "docs")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = left.column("kind").to_numpy()
        rows = left.filter(pa.array(kinds == DOCUMENT))
        tokens = left.filter(pa.array(kinds == SEGMENTS)).column("tokens")[0].as_py()
        whole, sizes_a, ids_a, ends_a, sizes_b, ids_b, ends_b = (unpacked(x) for x in tokens)
        aligned = Aligned(whole.astype(bool), sizes_a, ids_a, sizes_b, ids_b, ends_a, ends_b)
        pairs, n_links = aligned.links()
        key = (right.column("a").to_numpy().astype(np.int64) << 32) | right.column("b").to_numpy().astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        at = np.minimum(np.searchsorted(key, pairs), max(0, len(key) - 1))
        # Pairs that only segments of texts without tokens hold are not counted, nor asked for.
        hit = key[at] == pairs if len(key) else np.zeros(len(pairs), bool)
        bounds = np.r_[0, np.cumsum(n_links)]
        n, best_ = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        n[hit] = right.column("n").to_numpy()[order][at[hit]]
        best_[hit] = right.column("best").to_numpy(zero_copy_only=False)[order][at[hit]]
        count_sum, n_best = sums(n, bounds), sums(best_, bounds)
        text, text_sizes = aligned.written()
        text_at = np.r_[0, np.cumsum(text_sizes)]
        column = rows.column("codes")
        codes = [unpacked(x.as_py() or b"") for x in column]
        flat_codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        doc_at = np.r_[0, np.cumsum([len(c) for c in codes])].astype(np.int64)
        written = [text[spread(text_at[c], text_sizes[c])][:-1].tobytes() for c in codes]
        return pa.Table.from_arrays(
            [rows.column("id"), *[rows.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
             pa.array(sums(n_best[flat_codes], doc_at)), pa.array(sums(count_sum[flat_codes], doc_at)),
             pa.array(written, pa.binary()).cast(pa.string())],
            names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
        )

    done = stored.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        finish, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    )
    return done.withColumnRenamed("id", id_col)
