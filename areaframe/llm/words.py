"""Words and lines of many texts at once, as spans and 64-bit hashes, in numpy.

A span's hash is a polynomial over random 64-bit values per byte, read off one prefix
sum, so every span of a text costs the same whatever its length. Distinct words share
a value with a chance near 2**-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that begin a code point.
BEGINS = (np.arange(256) & 0xC0) != 0x80
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(None)
def values(seed: int, lower: bool) -> np.ndarray:
    """A random number per byte; A-Z share those of a-z where ``lower``."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95) + U(seed * 7919 + 1))
    return table[LOWER] if lower else table


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of spans of ``data``, from one pass over it."""

    def __init__(self, data: np.ndarray, lower: bool = False, seed: int = 0):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values(seed, lower)[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F))


def word_spans(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's range of words.
    ``marks`` are the texts' offsets; a word never reaches over one."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(marks), np.int64)
    solid = ~SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[marks[:-1][marks[:-1] < n]] = False
    after[marks[1:][marks[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, marks)


def line_spans(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, and each text's range of
    lines. Every text has at least one line, an empty text an empty one."""
    breaks = np.flatnonzero(data == 0x0A)
    n_lines = np.searchsorted(breaks, marks[1:]) - np.searchsorted(breaks, marks[:-1]) + 1
    bounds = np.zeros(len(marks), np.int64)
    np.cumsum(n_lines, out=bounds[1:])
    starts = np.empty(bounds[-1], np.int64)
    ends = np.empty(bounds[-1], np.int64)
    first = np.zeros(bounds[-1], bool)
    first[bounds[:-1]] = True
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    starts[first], starts[~first] = marks[:-1], breaks + 1
    ends[last], ends[~last] = marks[1:], breaks
    return starts, ends, bounds


def strip(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the space at both ends."""
    solid = np.flatnonzero(~SPACE[data])
    if len(solid) == 0:
        return starts, starts
    first = np.minimum(np.searchsorted(solid, starts), len(solid) - 1)
    last = np.searchsorted(solid, ends) - 1
    some = (solid[first] >= starts) & (solid[first] < ends)
    return np.where(some, solid[first], starts), np.where(some, solid[last] + 1, starts)


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte: differences count spans."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(BEGINS[data], out=sums[1:])
    return sums
