"""Toxicity by a factorization machine over hashed terms.

Terms are words without ASCII punctuation, A-Z lower-cased, and their first 4, 5 and 6 bytes, hashed into
``BUCKETS``.  The machine learns a weight for each term and a short vector whose products weigh every pair
of terms, so that two terms together can count for more than their sum.

It is fitted on a bounded sample: the ``sample`` labelled documents with the smallest hashes of their ids,
and the ``terms`` buckets that tell the classes apart best (both parameters).  Every document is scored on
its whole text.

Edge cases: null and blank texts have no term and get the score of the bias alone.  Null labels are left
out; of several labels of a document the largest counts, of several texts of a labelled id the first in order.  Without labels of both classes every score is the
share of positive labels, 0 if there are none.  Repeated rows are scored separately.  An empty table gives
an empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import materialize, small_batches
from quire.llm._vector import Words, chunks

BUCKETS = 1 << 20
SAMPLE = 12_000
TERMS = 4096
FACTORS = 4
THRESHOLD = 0.3
#: Found with the weight below by three-fold cross-validation on the rows that aren't held out.
DECAY = 5e-4
#: How much more a missed toxic document costs than a clean one that is blamed.
WEIGHT = 6.0


def term_hashes(texts: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket) of the distinct terms of each text, of those that ``keep`` marks."""
    for at, rows, data, offsets in chunks(texts):
        words = Words(data, offsets, punctuation=True)
        docs, found = [], []
        for n in (None, 4, 5, 6):
            here = slice(None) if n is None else np.flatnonzero(words.end - words.start >= n)
            hashes = words.hash if n is None else words.prefix(np.minimum(words.start + n, words.end))[here] ^ np.uint64(n)
            buckets = (hashes >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)
            doc = words.doc[here]
            if keep is not None:
                doc, buckets = doc[kept := keep[buckets]], buckets[kept]
            docs.append(doc)
            found.append(buckets)
        both = np.unique(np.concatenate(docs) * BUCKETS + np.concatenate(found))
        yield at, rows, both // BUCKETS, both % BUCKETS


def sampled_terms(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Label and terms (32-bit numbers as bytes) of the sampled documents; columns doc_id, text and doc_id, label."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for at, rows, doc, bucket in term_hashes(batch.column("text")):
                cuts = np.searchsorted(doc, np.arange(rows + 1))
                found = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(labels[at : at + rows], pa.int32()), pa.array(found, pa.binary())], names=["label", "terms"])

    # The sample's size is bounded by its parameter, so it may be sent to every executor.
    texts = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text"))
    return texts.select("label", "text").mapInArrow(terms, "label int, terms binary")


def fit(rows: list[tuple[int, bytes]], terms: int = TERMS, factors: int = FACTORS, steps: int = 150, rate: float = 0.05, decay: float = DECAY, weight: float = WEIGHT) -> dict:
    """Factorization machine by Adam on the logistic loss, in which a positive document counts ``weight`` times."""
    y = np.array([r[0] for r in rows], float)
    base = float(y.mean()) if len(y) else 0.0
    model = {"bias": np.log(base / (1 - base)) if 0 < base < 1 else None, "base": base, "buckets": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, factors))}
    if model["bias"] is None:
        return model
    # The driver never holds all terms as numbers, only those chosen, and one factor of each at a time.
    parts = [range(at, min(at + 500, len(rows))) for at in range(0, len(rows), 500)]
    docs_of = lambda part: np.repeat(np.array(part, np.int32), [len(rows[k][1]) // 4 for k in part])
    buckets_of = lambda part: np.frombuffer(b"".join(rows[k][1] for k in part), "<u4")
    n, positive = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for part in parts:
        n += np.bincount(buckets_of(part), minlength=BUCKETS)
        positive += np.bincount(buckets_of(part), weights=y[docs_of(part)], minlength=BUCKETS)
    score = np.where(n >= 3, np.abs(positive - n * base) / np.sqrt(np.maximum(n, 1) * base * (1 - base)), 0)
    best = np.sort(np.argsort(-score, kind="stable")[:terms])
    best = best[score[best] > 0]
    place = np.full(BUCKETS, -1)
    place[best] = np.arange(len(best))
    chosen = [(docs_of(part)[here := place[found := buckets_of(part)] >= 0], place[found[here]].astype(np.int32)) for part in parts]
    doc, term = (np.concatenate(c) for c in zip(*chosen, strict=True))
    random = np.random.default_rng(7)
    p = {"bias": np.array([model["bias"]]), "w": np.zeros(len(best)), "v": random.normal(0, 0.05, (len(best), factors))}
    first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by = lambda index, values, size: np.stack([np.bincount(index, v, size) for v in values], 1)
    each = range(factors)
    for step in range(1, steps + 1):
        v = p["v"]
        sums = by(doc, (v[term, f] for f in each), len(y))
        z = p["bias"][0] + np.bincount(doc, p["w"][term], len(y)) + 0.5 * (sums**2 - by(doc, (v[term, f] ** 2 for f in each), len(y))).sum(1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, weight, 1.0) / len(y)
        e = error[doc]
        gradient = {
            "bias": np.array([error.sum()]),
            "w": np.bincount(term, e, len(best)) + decay * p["w"],
            "v": by(term, (e * (sums[doc, f] - v[term, f]) for f in each), len(best)) + decay * v,
        }
        for k, g in gradient.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model | {"bias": float(p["bias"][0]), "w": p["w"], "v": p["v"], "buckets": best}


def _scores(texts: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(texts), model["base"])
    if model["bias"] is None:
        return out
    keep = np.zeros(BUCKETS, bool)
    keep[model["buckets"]] = True
    for at, rows, doc, bucket in term_hashes(texts, keep):
        term = np.searchsorted(model["buckets"], bucket)
        z = model["bias"] + np.bincount(doc, model["w"][term], rows)
        for f in range(model["v"].shape[1]):
            v = model["v"][term, f]
            z += 0.5 * (np.bincount(doc, v, rows) ** 2 - np.bincount(doc, v * v, rows))
        out[at : at + rows] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict:
    """The model fitted on the labelled documents that aren't held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(~_held_out(F.col("doc_id")))
    with small_batches(docs.sparkSession):
        found = sampled_terms(rows, known, sample).collect()
    return fit([(r["label"], r["terms"]) for r in found])


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Held-out documents' labels are not used."""
    model = learn(docs, labels, doc_id, text, label, sample)
    with small_batches(docs.sparkSession):
        scored = materialize(scores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), model))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below ``threshold``; a checkpoint, since Spark hands out as many rows at once as its setting says when they are read."""
    model = learn(docs, labels, doc_id, text, label, sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(text), model) < threshold))

    with small_batches(docs.sparkSession):
        return materialize(docs.mapInArrow(keep, docs.schema))
