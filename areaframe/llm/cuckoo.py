"""Cuckoo filters over 64-bit keys, filled and emptied many keys at a time."""

from __future__ import annotations

import numpy as np

from .words import U, mix

SLOTS = 4


class CuckooFilter:
    """Sixteen-bit fingerprints, four to a bucket, each key in one of two buckets.

    A key that was inserted is always found; another is found with a chance near
    8 in 65536. Keys must be inserted once each and removed only when inserted, which
    the exact table beside the filter makes sure of.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def write(self) -> bytes:
        return self.table.tobytes()

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return (mix(prints.astype(np.uint64)) & U(len(self.table) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spread = mix(keys.view(np.uint64) + U(0x632BE59BD9B4E019))
        prints = np.maximum(spread >> U(48), U(1)).astype(np.uint16)
        first = (spread & U(len(self.table) - 1)).astype(np.int64)
        return prints, first, first ^ self._jump(prints)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        wanted = prints[:, None]
        return ((self.table[first] == wanted) | (self.table[second] == wanted)).any(axis=1)

    def insert(self, keys: np.ndarray, most_rounds: int = 400) -> bool:
        """False where the filter is too full; it must then be built anew, larger."""
        prints, at, _ = self._places(keys)
        for turn in range(most_rounds):
            if not len(prints):
                return True
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            index = np.arange(len(at))
            opens = np.r_[True, at[1:] != at[:-1]]
            rank = index - np.maximum.accumulate(np.where(opens, index, 0))
            taken = self.table[at] != 0
            fits = rank < SLOTS - taken.sum(axis=1)
            slot = np.argsort(taken, axis=1, kind="stable")[index, np.minimum(rank, SLOTS - 1)]
            self.table[at[fits], slot[fits]] = prints[fits]
            prints, at, opens = prints[~fits], at[~fits], np.r_[True, at[~fits][1:] != at[~fits][:-1]][: (~fits).sum()]
            if turn and len(prints):
                # One key per full bucket takes the place of one that is there.
                chosen, where = np.flatnonzero(opens), turn % SLOTS
                held = self.table[at[chosen], where].copy()
                self.table[at[chosen], where] = prints[chosen]
                prints[chosen] = held
            at = at ^ self._jump(prints)
        return not len(prints)

    def remove(self, keys: np.ndarray) -> None:
        """Clears one print for each key, in its first bucket or else in its second. Keys that share bucket and print
        clear as many."""
        prints, at, second = self._places(keys)
        for _ in range(2):
            order = np.lexsort((prints, at))
            prints, at, second = prints[order], at[order], second[order]
            index = np.arange(len(at))
            opens = np.r_[True, (at[1:] != at[:-1]) | (prints[1:] != prints[:-1])][: len(at)]
            rank = index - np.maximum.accumulate(np.where(opens, index, 0)) if len(at) else index
            held = self.table[at] == prints[:, None]
            own = held & (np.cumsum(held, axis=1) == rank[:, None] + 1)
            found = own.any(axis=1)
            self.table[at[found], own[found].argmax(axis=1)] = 0
            prints, second = prints[~found], second[~found]
            at = second
