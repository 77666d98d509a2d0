from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm._common import ROWS_AT_ONCE, read
from quire.llm.queries import QUERIES
from tests.llm.helpers import TESTDATA, awkward, documents


def area(pairs):
    """Under the curve of (score, label)."""
    good, bad = [s for s, y in pairs if not y], [s for s, y in pairs if y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def judged(spark):
    """All results at sf0.1, and (score, label) of the labelled held-out ones."""
    folder = f"{TESTDATA}/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, folder, "labels").collect()}
    found = QUERIES["op9_toxicity"](spark, folder).collect()
    return found, [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and labels.get(r["doc_id"]) is not None]


def test_held_out_documents(judged):
    found, held = judged
    assert len(found) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert area(held) > 0.97
    blamed = [s >= 0.3 for s, y in held if not y]
    assert sum(blamed) / len(blamed) < 0.03


def test_most_held_out_toxic_documents_are_caught(judged):
    caught = [s >= 0.3 for s, y in judged[1] if y]
    assert sum(caught) / len(caught) >= 0.9


def test_held_out_labels_change_nothing(spark):
    folder = f"{TESTDATA}/sf0.001"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()}


def test_pairs_count_for_more_than_their_sum():
    r = random.Random(1)
    rows = []
    for _ in range(600):
        a, b = r.random() < 0.5, r.random() < 0.5
        terms = [k for k, there in ((1, a), (2, b)) if there] + [10 + r.randrange(5)]
        rows.append((int(a and b), b"".join(t.to_bytes(4, "little") for t in terms)))
    model = toxicity.fit(rows)
    at = {int(k): i for i, k in enumerate(model["buckets"])}
    assert model["v"][at[1]] @ model["v"][at[2]] > 0.5


def test_edges(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    rows = documents(spark, awkward())
    found = toxicity.toxicity(rows, labels).collect()
    assert len(found) == len(awkward()) and all(r["score"] is not None for r in found)
    assert {r["score"] for r in toxicity.toxicity(rows, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(rows.limit(0), labels).count() == 0
    assert toxicity.keep_clean(rows, labels.limit(0)).count() == len(awkward())


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    """Spark's usual 10,000 texts at once, in the JVM and in each Python worker, went with what else an executor holds beyond its memory."""
    monkeypatch.setattr(toxicity, "_scores", lambda texts, model: np.full(len(texts), len(texts) / 1e4))
    rows = spark.range(7000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    before = spark.conf.get(ROWS_AT_ONCE)
    assert max(r["score"] for r in toxicity.toxicity(rows, labels).collect()) <= 0.2
    assert toxicity.keep_clean(rows, labels).count() == 7000
    assert spark.conf.get(ROWS_AT_ONCE) == before


def test_terms_of_few_bytes_at_once():
    """Hashes of 1 MB of text at a time took 37 MB."""
    texts = pa.array([" ".join(f"word{k * 7919 % 50_000}" for k in range(j, j + 500)) for j in range(400)])
    model = toxicity.fit([(k % 2, np.array([k % 2, 9], "<u4").tobytes()) for k in range(40)], steps=1)
    toxicity._scores(texts[:1], model)
    tracemalloc.start()
    try:
        found = toxicity._scores(texts, model)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 400 and most < 20e6, most
