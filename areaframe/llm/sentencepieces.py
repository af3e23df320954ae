"""SentencePiece encoding and decoding: batched Viterbi over a model's pieces in numpy.

A text is cut where no piece can reach over: between two characters that stand side by side
in no piece. What lies between is a word here. The distinct words of a run of texts are
grouped by length and advance together: hashes of all their substrings probe the sorted
piece keys, and at each position the best last piece is an arg-max over piece lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import extend, extended, pieces
from .words import U, mix

MARK = 0x2581
#: Stands for a mark that the text itself holds; no piece has it, so it goes by its bytes.
LITERAL = 0x110000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_BASE = U(0x9E3779B97F4A7C15)
_UNKNOWN_PENALTY = 10.0


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))


def _ladder(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 21) | b.astype(np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for every start and size, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class WordCache:
    """Pieces of words met before in a task, by hash; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def add(self, keys: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> None:
        """``keys`` are sorted and new; their tokens follow each other."""
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.keys = np.insert(self.keys, at, keys)
        self.flat = np.concatenate([self.flat, tokens])


@dataclass(frozen=True)
class Pieces:
    """A model's pieces as arrays; fixed in size, so they travel with the task.

    A unigram model's scores are log-probabilities and are used as they are. A BPE model's
    are negative merge ranks, whose sums would favour the many small first merges; they are
    turned into log-probabilities by Zipf's rule, -ln(rank + 2).
    """

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    pairs: np.ndarray
    longest: int
    byte_ids: np.ndarray
    spelled: np.ndarray
    spelled_at: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        ranked = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        size = sp.get_piece_size()
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids, keys, pairs, spelled = [], [], set(), []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                spelled.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
                continue
            spelled.append(piece.replace("▁", " ").encode())
            codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            ids.append(i)
            whole = int((_values(codes) * _ladder(len(codes), int(_BASE))).sum())
            keys.append(whole * (2 * len(codes) + 1) % 2**64)
            pairs.update(_pairs(codes[:-1], codes[1:]).tolist())
        order = np.argsort(np.array(keys, np.uint64))
        sizes = np.array([0, *map(len, spelled)])
        scores = np.array([sp.get_score(i) for i in ids])
        if ranked:
            scores = -np.log(2 - scores)
        return cls(
            np.array(keys, np.uint64)[order],
            np.array(ids, np.int32)[order],
            scores[order],
            np.array(sorted(pairs), np.int64),
            max(len(sp.id_to_piece(i)) for i in ids),
            byte_ids,
            np.frombuffer(b"".join(spelled), np.uint8),
            np.cumsum(sizes),
        )

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Positions among the sorted keys, -1 where there is no such piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, (words, length) codes: flat ids and counts per word.
        Ties go to the longest last piece. A character without a piece has the score of the
        worst piece less 10 and stands as -1 - code."""
        n, length = codes.shape
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(_values(codes) * _ladder(length, int(_BASE)), axis=1, out=sums[:, 1:])
        down = _ladder(length, pow(int(_BASE), -1, 2**64))
        widths = range(min(self.longest, length), 0, -1)
        found, value = {}, {}
        for w in widths:
            spans = (sums[:, w:] - sums[:, :-w]) * down[: length - w + 1] * U(2 * w + 1)
            at = self._probe(spans)
            found[w] = np.where(at >= 0, self.ids[at], -1)
            value[w] = np.where(at >= 0, self.scores[at], -np.inf)
        alone = self.scores.min() - _UNKNOWN_PENALTY
        value[1] = np.where(found[1] >= 0, value[1], alone)
        found[1] = np.where(found[1] >= 0, found[1], -1 - codes.astype(np.int64))
        best = np.zeros((length + 1, n))
        back = np.zeros((length + 1, n), np.int64)
        for t in range(1, length + 1):
            options = [w for w in widths if w <= t]
            ways = np.stack([best[t - w] + value[w][:, t - w] for w in options])
            top = ways.argmax(axis=0)
            best[t] = ways[top, np.arange(n)]
            back[t] = np.array(options)[top]
        # From the ends back: every word takes its pieces right to left.
        out = np.zeros((n, length), np.int64)
        used = np.zeros((n, length), bool)
        at, row = np.full(n, length), np.arange(n)
        for _ in range(length):
            live = at > 0
            if not live.any():
                break
            r, t = row[live], at[live]
            w = back[t, r]
            for size in np.unique(w):
                one = w == size
                out[r[one], t[one] - size] = found[int(size)][r[one], t[one] - size]
            used[r, t - w] = True
            at[live] = t - w
        return out[used], used.sum(axis=1)

    def _learn(self, codes, starts, lengths, keys, cache: WordCache) -> None:
        """Words of one length at a time; long ones in smaller companies, so that the tables
        keep their size."""
        counts = np.zeros(len(keys), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(lengths).tolist():
            members = np.flatnonzero(lengths == size)
            step = max(1, (1 << 16) // size)
            for some in (members[i : i + step] for i in range(0, len(members), step)):
                tokens, n = self.viterbi(codes[starts[some][:, None] + np.arange(size)])
                counts[some] = n
                parts.append((some, tokens, n))
        flat = np.zeros(int(counts.sum()), np.int64)
        place = np.cumsum(counts) - counts
        for some, tokens, n in parts:
            flat[gather(np.arange(len(flat)), place[some], n)] = tokens
        cache.add(keys, counts, flat)

    def encode(
        self, data: np.ndarray, marks: np.ndarray, cache: WordCache
    ) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and their bounds."""
        begins = (data & 0xC0) != 0x80
        counted = np.zeros(len(data) + 1, np.int64)
        np.cumsum(begins, out=counted[1:])
        ends = counted[marks]
        plain = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        opens = ends[:-1][full] + np.arange(len(full))
        codes = np.empty(len(plain) + len(full), np.int64)
        mask = np.ones(len(codes), bool)
        mask[opens] = False
        codes[mask] = np.where(plain == MARK, LITERAL, np.where(plain == 0x20, MARK, plain))
        codes[opens] = MARK
        bounds = np.zeros(len(marks), np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), bounds
        pairs = _pairs(codes[:-1], codes[1:])
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        cut = np.ones(len(codes), bool)
        cut[1:] = self.pairs[at] != pairs
        cut[opens] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.r_[starts, len(codes)])
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_values(codes) * _ladder(len(codes), int(_BASE)), out=sums[1:])
        hashes = (sums[starts + lengths] - sums[starts]) * _ladder(len(codes), pow(int(_BASE), -1, 2**64))[starts]
        known, first, which = np.unique(
            mix(hashes + lengths.astype(np.uint64)), return_index=True, return_inverse=True
        )
        if len(cache.keys) > cache.most:
            cache.clear()
        new = np.flatnonzero(~cache.find(known)[1])
        if len(new):
            self._learn(codes, starts[first[new]], lengths[first[new]], known[new], cache)
        at, _ = cache.find(known)
        n_tokens = cache.counts[at][which]
        tokens = gather(cache.flat, cache.place[at][which], n_tokens)
        owner = np.repeat(np.searchsorted(opens, starts, "right") - 1, n_tokens)
        tokens, owner = self._with_bytes(tokens, owner)
        bounds[1:] = np.cumsum(np.bincount(full[owner], minlength=len(marks) - 1))
        return tokens.astype(np.int32), bounds

    def _with_bytes(self, tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece spelled by their bytes."""
        lost = np.flatnonzero(tokens < 0)
        if not len(lost):
            return tokens, owner
        known, inverse = np.unique(-1 - tokens[lost], return_inverse=True)
        spelled = [chr(MARK if c == LITERAL else c).encode() for c in known.tolist()]
        sizes = np.array([len(s) for s in spelled])
        flat = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        repeat = np.ones(len(tokens), np.int64)
        repeat[lost] = sizes[inverse]
        out = np.repeat(tokens, repeat)
        places = np.cumsum(repeat) - repeat
        spots = gather(np.arange(len(out)), places[lost], sizes[inverse])
        out[spots] = gather(flat, starts[inverse], sizes[inverse])
        return out, np.repeat(owner, repeat)

    def decode(self, tokens: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of token lists: pieces spelled out, less the space put before each text."""
        sizes = self.spelled_at[tokens + 1] - self.spelled_at[tokens]
        flat = gather(self.spelled, self.spelled_at[tokens], sizes)
        ends = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        whole = flat.tobytes()
        out = []
        for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist()):
            text = whole[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and, where ``check`` is set, ``round_trip``: whether
    decoding gives the text again.

    Defined cases: a null text has null ids, no tokens and a true round trip; an empty one has an
    empty list. A text's own marks (U+2581) are spelled by their bytes, so that decoding brings
    them back. Computed columns take the place of columns of their names.
    """
    own = Pieces.load(model)
    added = {"token_ids": "array<int>", "n_tokens": "bigint"} | ({"round_trip": "boolean"} if check else {})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for rows, data, marks in pieces(batches, text_col):
            tokens, bounds = own.encode(data, marks, cache)
            null = rows.column(rows.schema.get_field_index(text_col)).is_null()
            lists = pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(tokens), mask=null if null.true_count else None
            )
            out = {"token_ids": lists, "n_tokens": pa.array(np.diff(bounds))}
            if check:
                back = own.decode(tokens, bounds)
                size = np.diff(marks)
                same = [
                    data[a : a + n].tobytes() == text.encode() for a, n, text in zip(marks[:-1], size, back)
                ]
                out["round_trip"] = pa.array(same, pa.bool_())
            yield extend(rows, out)

    return docs.mapInArrow(task, extended(docs, added))


def decode(tokens: DataFrame, ids_col: str = "token_ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """``tokens`` with the texts of its id lists; null stays null."""
    own = Pieces.load(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(rows.schema.get_field_index(ids_col))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = own.decode(flat, np.r_[0, np.cumsum(sizes)].astype(np.int64))
            keep = lists.is_valid().to_pylist()
            yield extend(rows, {name: pa.array([t if k else None for t, k in zip(texts, keep)], pa.string())})

    return tokens.mapInArrow(task, extended(tokens, {name: "string"}))
