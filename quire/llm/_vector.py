"""Words and shingles of a whole batch of texts at once, with numpy on the bytes of the Arrow column.

A byte's value is a fixed random number times a power of ``BASE``; a word's hash is the difference of two
running sums, shifted to the word's start, and mixed.  64 bits: two different words or shingles agree with a
chance of about 2 ** -60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time (a longer text is taken whole); hashes and offsets of their words take many times as much.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_random = np.random.default_rng(20240601)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and all ASCII characters but letters and digits.
_PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of about ``size`` bytes each; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1, at + 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words of a chunk: ``doc`` (row), ``hash`` and the bytes' places, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, punctuation: bool = False):
        n = len(data)
        data = _LOWER[data]
        inside = ~(_PUNCTUATION if punctuation else _SPACE)[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _power("up", BASE, n), out=self.sums[1:])
        self.shift = _power("down", _INVERSE, n + 1)[self.start]
        self.hash = self.prefix(self.end)

    def prefix(self, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to ``end``."""
        return mix((self.sums[end] - self.sums[self.start]) * self.shift)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, hash) of each n words in a row of one text."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + self.hash[at + k])
        return self.doc[at], at, out
