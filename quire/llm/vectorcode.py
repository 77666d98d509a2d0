"""Vector code compression: a byte for each part of a vector, codebooks by Lloyd's algorithm with Yinyang bounds, in whole numbers.

1. Components become ``floor(4096 x)``, vectors are cut into ``PARTS`` equal parts; a part's codebook starts as
   that part of the ``ENTRIES`` vectors with the smallest ids.
2. The entries of a codebook are clustered into ``GROUPS`` groups.  Each part of a vector keeps its entry and, for each
   group, a lower bound of its distance to all entries there but its own.
3. In a round entries move; a group's bound falls by the farthest that one of its entries moved.  Where the bound is
   still above the distance to the part's own entry, no entry of the group can be nearer or as near, and the group isn't
   scanned.  Other groups are scanned with whole numbers, which also settles ties: the lower index wins.
4. Bounds are kept in single precision and rounded down, distances to own entries are whole numbers, so the assignment is
   exactly that of a full search in each round.

The vectors, with entries and bounds, are a table written each round; the driver holds the codebooks, ``PARTS * ENTRIES``
entries, and gets the sums of as many.

Edge cases: null vectors, and those with a null or non-finite component, are left out.  The others have one length, a
multiple of ``PARTS`` (an error otherwise; empty vectors have code 00 throughout).  Components lie within +-131072,
beyond which squares leave 64 bits (an error).  Of rows that share an id all are coded; ties for the first ids are
broken by the bytes of the integers, and null ids come last.  With fewer than ``ENTRIES`` vectors the codebooks have as many entries.
No vector, no row.  Columns other than id, vector and label are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import Tables

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
GROUPS = 4
#: Lloyd rounds over the entries of one codebook that make its groups.
GROUP_ROUNDS = 5
LARGEST = 1 << 29
#: Bounds are lowered by this share, many times the error of single precision.
SLACK = 1e-5


def grouped(book: np.ndarray) -> np.ndarray:
    """The group of each entry of a codebook, by a few rounds of Lloyd's algorithm over the entries."""
    points = book.astype(np.float64)
    k = min(GROUPS, len(points))
    centres = points[:: max(1, len(points) // k)][:k].copy()
    group = np.zeros(len(points), np.int64)
    for _ in range(GROUP_ROUNDS):
        group = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(k):
            if (group == g).any():
                centres[g] = points[group == g].mean(axis=0)
    return group


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, in whole numbers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def _below(squared: np.ndarray) -> np.ndarray:
    """Distances, rounded down."""
    return (np.sqrt(squared) * (1 - SLACK)).astype(np.float32)


class Codebook:
    """The entries of one part in a round, their groups, and how far each has moved since the round before."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None, group: np.ndarray):
        self.entries, self.group = entries, group
        self.of = [np.flatnonzero(group == g) for g in range(GROUPS)]
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64))
        self.drift = np.array([moved[o].max(initial=0.0) for o in self.of]) * (1 + SLACK)

    def assign(self, x: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(squared distance to the nearest entry, that entry, distances computed); ``own`` and ``bounds`` are brought up to date in place."""
        bounds -= self.drift
        bounds -= np.abs(bounds) * np.float32(SLACK)
        now = ((x - self.entries[own]) ** 2).sum(axis=1)
        reach = np.sqrt(now.astype(np.float64)) * (1 + SLACK)
        best, at, computed = now.copy(), own.astype(np.int64), len(x)
        scans = []
        for g, members in enumerate(self.of):
            rows = np.flatnonzero(bounds[:, g] <= reach) if len(members) else np.zeros(0, np.int64)
            if not len(rows):
                continue
            found = _squared(x[rows], self.entries[members])
            computed += found.size
            least = found.argmin(axis=1)
            first, second = found[np.arange(len(rows)), least], np.partition(found, 1, axis=1)[:, 1] if len(members) > 1 else np.full(len(rows), np.iinfo(np.int64).max)
            scans.append((g, rows, members[least], first, second))
            better = (first < best[rows]) | ((first == best[rows]) & (members[least] < at[rows]))
            best[rows[better]], at[rows[better]] = first[better], members[least][better]
        left = at != own
        # A group that wasn't scanned has the entry left behind among its others.
        groups = self.group[own]
        bounds[left, groups[left]] = np.minimum(bounds[left, groups[left]], _below(now[left]))
        for g, rows, nearest, first, second in scans:
            bounds[rows, g] = _below(np.where(nearest == at[rows], second, first))
        own[:] = at
        return best, at, computed


def _integers(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    values = np.frombuffer(b"".join(batch.column(name).to_pylist()), np.int32)
    return values.reshape(len(batch), PARTS, width // PARTS).astype(np.int64)


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, n (length) and whole (the integers, four bytes each) of the vectors kept."""
    x = F.col("v")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(x.isNotNull() & ~bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            length = np.diff(column.offsets.to_numpy())
            whole = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
            if len(whole) and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"components have to lie within +-{LARGEST // SCALE}")
            data, cuts = whole.astype(np.int32), np.concatenate([[0], np.cumsum(length)])
            packed = pa.array([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(length, pa.int32()), packed], names=["vec_id", "label", "n", "whole"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, n int, whole binary")


def _round(state: DataFrame, width: int, books: list[np.ndarray], before: list[np.ndarray] | None, groups: list[np.ndarray]) -> DataFrame:
    """``state`` with entries, bounds, the vector's error and the number of ``distances`` computed, after one assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Codebook(b, None if before is None else before[p], groups[p]) for p, b in enumerate(books)]
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            x = _integers(batch, "whole", width)
            own = np.zeros((rows, PARTS), np.uint8)
            bounds = np.full((rows, PARTS, GROUPS), -np.inf, np.float32)
            if before is not None:
                own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(rows, PARTS).copy()
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(rows, PARTS, GROUPS).copy()
            error, distances = np.zeros(rows, np.int64), 0
            for p, part in enumerate(parts):
                squared, _, computed = part.assign(x[:, p], own[:, p], bounds[:, p])
                error, distances = error + squared, distances + computed
            share = np.zeros(rows, np.int64)
            share[0] = distances
            out = [batch.column(c) for c in ("vec_id", "label", "whole")]
            out += [pa.array([o.tobytes() for o in own], pa.binary()), pa.array([b.tobytes() for b in bounds], pa.binary()), pa.array(error), pa.array(share)]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label", "whole", "own", "bounds", "error", "distances"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, whole binary, own binary, bounds binary, error long, distances long")


def _moved(state: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the mean of its parts, rounded down; unused ones stay."""
    wide, size = width // PARTS, len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS * size, wide), np.int64), np.zeros(PARTS * size, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _integers(batch, "whole", width).reshape(len(batch) * PARTS, wide)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(len(batch), PARTS)
            entry = (own + np.arange(PARTS) * size).reshape(-1)
            np.add.at(sums, entry, x)
            counts += np.bincount(entry, minlength=PARTS * size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    found = state.select("whole", "own").mapInArrow(run, "entry int, n long, sums array<long>")
    # As many rows as all codebooks have entries; sums of many vectors leave 64 bits.
    total = found.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(wide))).collect()
    moved = [b.copy() for b in books]
    for r in total:
        moved[r["entry"] // size][r["entry"] % size] = [int(r[f"s{k}"]) // r["n"] for k in range(wide)]
    return moved


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for b in books for v in b.reshape(-1))


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, own (an entry of each part, a byte each), error and the number of distances computed; the codebooks)."""
    tables = Tables(vectors.sparkSession)
    state = tables.store(prepared(vectors, vec_id, embedding, label))
    lengths = state.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    width = lengths["most"] or 0
    if lengths["least"] != lengths["most"] or width % PARTS:
        raise ValueError(f"vectors need one length, a multiple of {PARTS}")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()
    start = np.array([np.frombuffer(r["whole"], np.int32) for r in first], np.int64).reshape(len(first), PARTS, width // PARTS)
    books, before = [start[:, p].copy() for p in range(PARTS)], None
    groups = [grouped(b) if width and len(b) else np.zeros(len(b), np.int64) for b in books]
    for k in range(rounds + 1):
        done, state = state, tables.store(_round(state, width, books, before, groups))
        tables.drop(done)
        if k < rounds:
            before, books = books, _moved(state, width, books)
    return state, books


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = encode(vectors, vec_id, embedding, label)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = coded.alias("c").join(total.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return out.select("vec_id", F.lower(F.hex("own")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
