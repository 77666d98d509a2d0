from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from quire.llm import vectorcode
from quire.llm._common import read
from quire.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import CLASHING, TESTDATA
from tests.oracle import same_rows


def brute(rows):
    """vec_id -> (code, error, label_error, codebooks_sha256) of (vec_id, vector, label) rows, by full search."""
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[math.floor(4096 * v) for v in r[1]] for r in rows], np.int64)
    x = x.reshape(len(rows), 8, -1)
    books = [x[:16, p].copy() for p in range(8)]
    for k in range(7):
        squared = [((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(8)]
        own = [s.argmin(axis=1) for s in squared]
        for p in range(8 if k < 6 else 0):
            for e in set(own[p].tolist()):
                books[p][e] = x[own[p] == e, p].sum(axis=0) // (own[p] == e).sum()
    error = sum(s.min(axis=1) for s in squared)
    labels: dict = {}
    for r, e in zip(rows, error):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return {r[0]: ("".join(f"{o[k]:02x}" for o in own), int(error[k]), labels[r[2]], digest) for k, r in enumerate(rows)}


def result(frame):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect()}


def vectors(spark, rows, kind="double"):
    extra = ", ".join(f"`{c}` string" for c in (*CLASHING, "own", "bounds", "error", "whole") if c != "label")
    count = extra.count("string")
    return spark.createDataFrame([(i, v, c, *["junk"] * count) for i, v, c in rows], f"vec_id long, embedding array<{kind}>, label int, {extra}")


def test_sql(spark):
    same_rows(spark, QUERIES["op12_vector_codes"], ORACLES["op12_vector_codes"], f"{TESTDATA}/sf0.01")


def test_whole_table(spark):
    folder = f"{TESTDATA}/sf0.1"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, folder, "embeddings").collect()]
    assert result(QUERIES["op12_vector_codes"](spark, folder)) == brute(rows)


def test_bounds_spare_most_distances(spark):
    frame = read(spark, f"{TESTDATA}/sf0.1", "embeddings")
    coded, _ = vectorcode.encode(frame)
    rows = frame.count()
    full = rows * vectorcode.PARTS * vectorcode.ENTRIES
    # In the last round alone, where hardly an entry moves.
    assert coded.groupBy().sum("distances").first()[0] < full / 2


def test_ties_and_equal_entries(spark):
    # Few different values, so that entries are equal, parts lie halfway, and some entries are never used.
    r = np.random.default_rng(4)
    rows = [(k, (r.integers(-2, 3, 16) / 4096).tolist(), int(k % 3) if k % 5 else None) for k in range(500)]
    assert result(vectorcode.vector_codes(vectors(spark, rows))) == brute(rows)


def test_clusters_far_apart(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 20, (40, 24))
    rows = [(k, (centres[k % 40] + r.normal(0, 0.5, 24)).tolist(), k % 4) for k in range(1500)]
    assert result(vectorcode.vector_codes(vectors(spark, rows))) == brute(rows)


def test_edges(spark):
    good = [(k * 3 % 31, [float(k + p) / 7 for p in range(8)], None if k % 2 else 1) for k in range(10)]
    bad = [(50, None, 1), (51, [None] * 8, 1), (52, [float("nan")] * 8, 1), (53, [float("inf")] + [0.0] * 7, 1), (54, [0.0] * 7 + [float("-inf")], None)]
    assert result(vectorcode.vector_codes(vectors(spark, good + bad))) == brute(good)
    assert result(vectorcode.vector_codes(vectors(spark, good, "float"))) == brute([(i, np.array(v, np.float32).astype(float).tolist(), c) for i, v, c in good])
    assert vectorcode.vector_codes(vectors(spark, [])).count() == 0
    assert vectorcode.vector_codes(vectors(spark, bad)).count() == 0
    assert {r["code"] for r in vectorcode.vector_codes(vectors(spark, [(1, [], 1), (2, [], None)])).collect()} == {"00" * 8}


def test_rows_that_share_an_id_and_null_ids(spark):
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [0.25] * 8, 1), (1, [0.125] * 8, 2)]
    found = vectorcode.vector_codes(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"] or 99, r["code"], r["error"]) for r in found) == [(1, "00" * 8, 0), (1, "01" * 8, 0), (1, "01" * 8, 0), (99, "03" * 8, 0)]


@pytest.mark.parametrize("rows", [[(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)], [(1, [200_000.0] * 8, 1)]])
def test_vectors_that_cannot_be_cut(spark, rows):
    with pytest.raises(Exception):
        vectorcode.vector_codes(vectors(spark, rows)).collect()
