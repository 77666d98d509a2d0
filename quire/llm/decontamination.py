"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman scores the pairs.

1. Every word n-gram of every test item is a seed, however often it occurs.  Frequencies can't tell which ones
   to leave out: those that an edit destroyed are the rarest ones, and those of a leaked item are common.
2. Around each seed in a document lies a window.  No alignment has more matches than the item and the window
   have words in common, each counted as often as in both, so windows with too few for the threshold are left
   out; no pair that reaches it is lost by that.
3. The other windows are aligned with the item (match 2, mismatch and gap -1).  A pair's score is that of the
   best local alignment divided by that of an exact copy of the item.

A copy without ``N`` words in a row of its item isn't found, even if its score would reach the threshold.

Items are taken in blocks of at most ``BLOCK`` n-grams, so what is sent to the executors is bounded however
large the benchmark; each block meets all documents.  Words are runs of letters, digits and non-ASCII
characters, A-Z lower-cased.

Edge cases: null and empty texts have no words and match nothing.  An item with fewer words than an n-gram
is matched as one n-gram of its own length.  Repeated items are scored separately; rows with the same id,
or without one, count as one document or item, which has the best score of its rows.  Empty tables give an empty result.  Other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._vector import Words, chunks, mix

N = 3
BLOCK = 200_000
THRESHOLD = 0.45
MATCH, MISS, GAP = 2, -1, 1
#: Alignments worked on together.
TOGETHER = 64
#: Seeds, or words of windows, worked on together.
AT_ONCE = 1 << 20


def _words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words."""
    out: list[np.ndarray] = []
    for _, rows, data, offsets in chunks(pa.array(texts, pa.string())):
        words = Words(data, offsets, punctuation=True)
        out += np.split(words.hash, np.searchsorted(words.doc, np.arange(1, rows)))
    return out


class Items:
    """A block of test items: their words and their n-grams with the items and places they have."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        found = [(i, w) for i, w in zip(ids, _words(texts), strict=True) if len(w)]
        self.ids, self.words = [i for i, _ in found], [w for _, w in found]
        self.sizes = sorted({min(N, len(w)) for w in self.words})
        grams = [(_grams(w), k) for k, w in enumerate(self.words)]
        self.hash = np.concatenate([g for g, _ in grams] or [np.zeros(0, np.uint64)])
        self.item = np.concatenate([np.full(len(g), k) for g, k in grams] or [np.zeros(0, np.int64)])
        self.place = np.concatenate([np.arange(len(g)) for g, _ in grams] or [np.zeros(0, np.int64)])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = (x[order] for x in (self.hash, self.item, self.place))
        self.length = np.array([len(w) for w in self.words], np.int64)
        words = np.concatenate(self.words or [np.zeros(0, np.uint64)])
        #: Each item's words, and how often it has them.
        self.vocabulary, self.copies = np.unique(_of(words, np.repeat(np.arange(len(self.words)), self.length)), return_counts=True)


def _of(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hashes of words as words of an item."""
    return mix(words + item.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _grams(words: np.ndarray) -> np.ndarray:
    one = Words.__new__(Words)
    one.doc, one.hash = np.zeros(len(words), np.int64), words
    return one.grams(min(N, len(words)))[2]


class _Finder:
    """Membership in a set of hashes: a bitmap first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(42)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == len(self.hashes)] = 0
        return at[self.hashes[place] == hashes[at]] if len(self.hashes) else at[:0]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int]]:
    """Best local alignment of each item with its window: score and where it ends in the window."""
    height, width = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), height), np.uint64), np.ones((len(items), width), np.uint64)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    slope = GAP * np.arange(width)
    above, best, end = np.zeros((len(items), width), np.int32), np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for row in range(height):
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        cell = np.maximum(diagonal + np.where(a[:, row, None] == b, MATCH, MISS), above - GAP)
        cell = np.maximum(cell, 0)
        # Gaps along the window: the largest score to the left less a gap for each word between.
        above = (np.maximum.accumulate(cell + slope, axis=1) - slope).astype(np.int32)
        at = above.argmax(1)
        top = above[np.arange(len(items)), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return list(zip(best.tolist(), end.tolist(), strict=True))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``AT_ONCE`` together, one number at least."""
    so_far, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(so_far, so_far[at] + AT_ONCE, side="right")) - 1, at + 1)
        yield at, to
        at = to


def _spread(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for each of the ranges."""
    return np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


def _windows(words: Words, items: Items, finder: _Finder) -> Iterator[np.ndarray]:
    """Rows of (row, item, first word): the windows around seeds, an item's length before and after; near ones count once."""
    for size in items.sizes:
        doc, at, hashes = words.grams(size)
        seeds = finder(hashes)
        low, high = (np.searchsorted(items.hash, hashes[seeds], side=side) for side in ("left", "right"))
        for a, b in _slices(high - low):
            n = (high - low)[a:b]
            k = _spread(low[a:b], n)
            item = items.item[k]
            length = items.length[item]
            start = np.repeat(at[seeds[a:b]], n) - items.place[k]
            # Two overlapping grids of windows: any alignment near the seed's diagonal lies inside its own.
            yield np.unique(np.stack([np.repeat(doc[seeds[a:b]], n), item, (start + length // 2) // length * length - length], axis=1), axis=0)


def _enough(words: Words, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the windows (words low to high) share enough words with their item for the threshold."""
    out = np.zeros(len(item), bool)
    for a, b in _slices(high - low):
        n = (high - low)[a:b]
        window = np.repeat(np.arange(b - a), n)
        hashes = _of(words.hash[_spread(low[a:b], n)], np.repeat(item[a:b], n))
        place = np.searchsorted(items.vocabulary, hashes)
        place[place == len(items.vocabulary)] = 0
        there = items.vocabulary[place] == hashes
        both, count = np.unique(window[there] * len(items.vocabulary) + place[there], return_counts=True)
        shared = np.bincount(both // len(items.vocabulary), np.minimum(count, items.copies[both % len(items.vocabulary)]), minlength=b - a)
        out[a:b] = MATCH * shared / (MATCH * items.length[item[a:b]]) >= threshold
    return out


def matches(docs: DataFrame, items: Items, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id and score of the windows that have a seed and may reach the threshold; columns doc_id and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(np.unique(items.hash))
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, punctuation=True)
                starts = np.searchsorted(words.doc, np.arange(rows + 1))
                out: tuple[list, list, list] = ([], [], [])
                for found in _windows(words, items, finder):
                    length = items.length[found[:, 1]]
                    low = np.maximum(found[:, 2], starts[found[:, 0]])
                    high = np.minimum(found[:, 2] + 3 * length, starts[found[:, 0] + 1])
                    todo = np.flatnonzero(_enough(words, items, found[:, 1], low, high, threshold))
                    # Of like size, so that little is padded.
                    todo = todo[np.argsort(length[todo], kind="stable")]
                    for k in range(0, len(todo), TOGETHER):
                        some = todo[k : k + TOGETHER]
                        own = [items.words[i] for i in found[some, 1]]
                        windows = [words.hash[x:y] for x, y in zip(low[some], high[some], strict=True)]
                        for (row, item, _), x, (score, _) in zip(found[some].tolist(), own, align(own, windows), strict=True):
                            for column, value in zip(out, (ids[first + row].as_py(), items.ids[item], score / (MATCH * len(x))), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["doc_id", "item_id", "score"])

    return docs.mapInArrow(find, "doc_id long, item_id long, score double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document and test item whose best alignment reaches ``threshold``: doc_id, item_id, score."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for items in blocks(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")), block):
        one = matches(rows, items, threshold)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return found.where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Items]:
    """The items in blocks of about ``block`` characters' worth of n-grams, read one after the other."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for r in benchmark.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "") // 3
        if size >= block:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)
