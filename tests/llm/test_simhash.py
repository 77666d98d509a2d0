from __future__ import annotations

import random

import numpy as np
import xxhash

from quire.llm import simhash
from quire.llm._common import Tables, read
from quire.llm.jaccard import components
from quire.llm.queries import QUERIES
from tests.llm.helpers import TESTDATA, awkward, documents, prose, words

_LOWER = {k: k + 32 for k in range(65, 91)}


def fingerprint(text) -> int:
    w = words((text or "").translate(_LOWER))
    found = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(values: dict) -> dict:
    """id -> smallest id reachable, from id -> fingerprint."""
    ids = sorted(values)
    codes = np.array([values[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[k]) <= 2):
            a, b = sorted((root(k), root(int(j))))
            parent[b] = a
    return {i: ids[root(k)] for k, i in enumerate(ids)}


def brute(rows):
    values = {i: fingerprint(t) for i, t in rows}
    low = reached(values)
    return {i: (f"{v:016x}", low[i]) for i, v in values.items()}


def result(frame):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in frame.collect()}


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def of_fingerprints(spark, values):
    """fingerprint -> smallest one reachable, by the operator's links."""
    tables = Tables(spark)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r["class"]: r["component"] for r in components(simhash.links(frame, tables), tables).collect()}
    return {signed(v): found.get(signed(v), signed(v)) for v in values}


def test_whole_table(spark):
    folder = f"{TESTDATA}/sf0.01"
    rows = [tuple(r) for r in read(spark, folder, "documents").select("doc_id", "text").collect()]
    found = QUERIES["op11_simhash_near_dedup"](spark, folder)
    assert set(found.columns) >= {"doc_id", "fingerprint", "component_id"}
    assert result(found) == brute(rows)


def test_edited_texts(spark):
    r, rows = random.Random(2), []
    for k in range(60):
        w = prose(k, r.choice([1, 2, 3, 4, 40, 600])).split()
        for _ in range(4):
            copy = list(w)
            copy[r.randrange(len(copy))] = "Edited"
            rows.append((len(rows), r.choice([" ", "\n", "\t  "]).join(copy)))
    rows += [(len(rows) + k, "Wörter ÀÉ ABC déf 😀 und noch mehr") for k in range(3)]
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    assert result(simhash.simhash(documents(spark, rows))) == want


def test_fingerprints_at_every_pair_of_bits(spark):
    r, values = random.Random(5), set()
    for a in range(64):
        for b in range(a, 64, 7):
            v = r.getrandbits(64)
            values |= {v, v ^ (1 << a) ^ ((1 << b) if b != a else 0)}
        v = r.getrandbits(64)
        values |= {v, v ^ 7 << (a % 60)}
    want = reached({signed(v): v for v in values})
    assert of_fingerprints(spark, values) == want


def test_crowd_of_near_fingerprints(spark):
    # Far more share a half than are compared with each other; many lie three or four bits off, some in chains.
    r = random.Random(8)
    middle, values = r.getrandbits(64), set()
    for _ in range(700):
        v = middle
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            v ^= 1 << r.randrange(64)
        values.add(v)
    for half in range(2):
        for _ in range(300):
            values.add((middle & (0xFFFFFFFF << 32 * half)) | r.getrandbits(32) << 32 * (1 - half))
    want = reached({signed(v): v for v in values})
    assert len(set(want.values())) > 300
    assert of_fingerprints(spark, values) == want


def test_rows_that_share_an_id(spark):
    rows = [(2, "b one two"), (4, "a three four"), (4, "b one two"), (7, "a three four"), (None, "a three four"), (None, "something else entirely")]
    found = simhash.simhash(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 99, r["component_id"] or -1) for r in found) == [(2, 2), (4, 2), (4, 2), (7, 2), (99, -1), (99, 2)]


def test_ids_of_any_type(spark):
    rows = [("b", "some words here"), ("a", "some words here"), ("c", None)]
    found = simhash.simhash(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {"a": "a", "b": "a", "c": "c"}


def test_edges(spark):
    rows = awkward()
    found = simhash.simhash(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found if r["doc_id"] not in (4, None)}
    assert {(by[k]["fingerprint"], by[k]["component_id"]) for k in (1, 2, 3)} == {("0" * 16, 1)}
    assert by[5]["component_id"] == 4 and by[6]["fingerprint"] == f"{fingerprint(rows[8][1]):016x}"
    assert simhash.simhash(documents(spark, [])).count() == 0
