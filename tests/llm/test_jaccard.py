from __future__ import annotations

import random
import time

import duckdb
import numpy as np

from quire.llm import jaccard
from quire.llm.jaccard import jaccard_join
from quire.llm._common import read
from quire.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import TESTDATA, awkward, documents, prose, words

_LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {}
    for i, text in rows:
        w = words((text or "").translate(_LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where: dict = {}
    for i in sorted(sets):
        shared: dict = {}
        for s in sets[i]:
            for j in where.get(s, ()):
                shared[j] = shared.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def test_whole_table(spark):
    folder = f"{TESTDATA}/sf0.01"
    rows = [tuple(r) for r in read(spark, folder, "documents").select("doc_id", "text").collect()]
    assert result(QUERIES["op10_ngram_jaccard_join"](spark, folder)) == brute(rows)


def test_sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TESTDATA}/sf0.01/documents.parquet'")
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert {i: (n, c) for i, n, c in con.sql(ORACLES["op10_ngram_jaccard_join"]).fetchall()} == brute(rows)


def test_edited_copies(spark):
    seed, r = 0, random.Random(0)
    rows = []
    for k in range(40):
        w = prose(seed * 1000 + k, r.randrange(3, 80)).split()
        for _ in range(r.randrange(1, 6)):
            copy = list(w)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(5)}"
            rows.append((len(rows), " ".join(copy).upper() if r.random() < 0.2 else "\n".join(copy)))
    assert result(jaccard_join(documents(spark, rows))) == brute(rows)


def test_large_group_of_near_copies(spark):
    # Many more than make a star, in a chain of small edits.
    w = prose(9, 60).split()
    rows = []
    for k in range(220):
        w = list(w)
        w[(k * 7) % 60] = f"n{k}"
        rows.append((k, " ".join(w)))
    assert result(jaccard_join(documents(spark, rows))) == brute(rows)


def test_groups_of_several_classes_in_a_large_list(spark):
    # 80 groups share the shingles of one opening; a fourth of them have a second class with another ending, and
    # the class that stands for the group is the one that the hub joins.
    opening, first, second = prose(1, 19, 5000), prose(2, 36, 5000), prose(3, 36, 5000)
    text = lambda k, ending: f"start{k} {opening} e1 e2 e3 e4 c1 c2 c3 c4 {ending}"

    def set_hash(x):
        data = x.encode()
        hashes = jaccard.shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1]
        return int(jaccard._classes(hashes, np.array([len(hashes)]))[0])

    texts = [text(k, first) for k in range(80)]
    texts += [text(k, second) for k in range(80) if set_hash(text(k, first)) < set_hash(text(k, second))][:20]
    # Endings are so common that they lie behind all prefixes.
    texts += [f"e1 e2 e3 e4 c1 c2 c3 c4 {first} e1 e2 e3 e4 c1 c2 c3 c4 {second}"] * 400
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len(texts) == 500 and len({c for _, c in want.values()}) == 3
    assert result(jaccard_join(documents(spark, rows))) == want


def test_rows_that_share_an_id(spark):
    b, a = prose(5, 30), prose(6, 30)
    found = jaccard_join(documents(spark, [(2, b), (4, a), (4, b), (7, a), (None, a), (None, "nothing like it")])).collect()
    assert [r["component_id"] for r in sorted(found, key=lambda r: (r["doc_id"] or 99, r["n_shingles"]))] == [2, 2, 2, 2, None, 2]


def test_links_by_rows_without_id(spark):
    w = prose(8, 60).split()
    rows = [(1, " ".join(w)), (None, " ".join([*w[:-3], "x", "y", "z"])), (2, " ".join(["p", "q", "r", *w[3:-3], "x", "y", "z"]))]
    assert {r["component_id"] for r in jaccard_join(documents(spark, rows)).collect()} == {1}


def test_ids_of_any_type(spark):
    rows = [("b", prose(1, 30)), ("a", prose(1, 30)), ("c", None)]
    found = jaccard_join(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {"a": "a", "b": "a", "c": "c"}


def test_edges(spark):
    rows = awkward()
    found = jaccard_join(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found if r["doc_id"] != 4}
    assert (by[1]["n_shingles"], by[1]["component_id"]) == (0, 1) and (by[3]["n_shingles"], by[3]["component_id"]) == (0, 3)
    assert by[5]["component_id"] == 4
    assert sorted((r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] == 4) == [(1, 4), (1, 4), (2, 4)]
    assert jaccard_join(documents(spark, [])).count() == 0


def near_but_unlinked(n: int):
    """Documents of one template, each with enough words of its own that no two link: similarities of about 0.7, three links among them."""
    template = prose(21, 120, 10_000).split()
    rows = []
    for k in range(n):
        w = list(template)
        for j in range(3):
            w[(k * 7 + j * 40) % 120] = f"own{k}x{j}"
        rows.append((k, " ".join(w)))
    return rows + [(n + k, rows[k * 5][1] + " more") for k in range(3)]


def test_near_but_unlinked_documents_are_verified_once(spark, monkeypatch):
    pairs, rows = [], near_but_unlinked(400)
    verified = jaccard._verified

    def counted(found, *more):
        pairs.extend((r["a"], r["b"]) for r in found.collect())
        return verified(found, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    start = time.time()
    assert result(jaccard_join(documents(spark, rows))) == brute(rows)
    assert time.time() - start < 120
    assert len({frozenset(p) for p in pairs}) == len(pairs) <= 403 * 402 // 2


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(1)
    for n in (1, 5, 90, 700, 5000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for changed in (0, 1, len(x) // 10, len(x) // 9):
            y = np.concatenate([x[changed:], r.integers(0, 1 << 63, changed).astype(np.uint64)])
            found = jaccard.sketches(np.repeat([0, 2], [len(x), len(y)]), np.concatenate([x, y]), 3)
            assert np.bitwise_count(found[0] ^ found[2]).sum() <= len(np.setxor1d(x, y)) and not found[1].any()


def test_prefixes_are_on_disk_only_until_they_are_listed(spark, monkeypatch):
    """Once the lists are there, no table with prefixes is left."""
    store, drop, live, later = jaccard.Tables.store, jaccard.Tables.drop, {}, []

    def stored(self, df):
        if later or any("rest" in columns for columns in live.values()):
            later.append(sum("prefix" in columns for columns in live.values()))
        out = store(self, df)
        live[id(out)] = out.columns
        return out

    def dropped(self, *frames):
        for frame in frames:
            live.pop(id(frame), None)
        drop(self, *frames)

    monkeypatch.setattr(jaccard.Tables, "store", stored)
    monkeypatch.setattr(jaccard.Tables, "drop", dropped)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "n o p q r s")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert later and not any(later)
