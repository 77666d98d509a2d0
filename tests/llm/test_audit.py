from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from quire.llm._common import read
from quire.llm.audit import filter_audit, masks
from quire.llm._common import Tables
from quire.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import CLASHING, TESTDATA, words
from tests.oracle import same_rows

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(rows):
    """The failed filters of each (doc_id, text, lang) row."""
    first: dict = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, _ in rows:
        text = text or ""
        w = words(text)
        bad = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > first[text],
        }
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    """(part, order, step) -> the counts, by applying the filters one after the other."""
    marks: dict = {}
    for i, q, t in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    found = failures(rows)
    out, total = {}, {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, found) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                failing = sum(k in f for _, f in own)
                label = [marks.get(i, (0, 0)) if i is not None else (0, 0) for i, _ in gone]
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(f == {k} for _, f in own), sum(m[0] for m in label), sum(m[1] for m in label))
                total[part, k] = total.get((part, k), 0) + len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def result(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*COLUMNS, "shapley")) for r in frame.collect()}


def tables(spark, rows, labels):
    extra = ", ".join(f"`{c}` string" for c in (*CLASHING, "fp", "fails", "digest", "first"))
    docs = spark.createDataFrame([(*r, *["junk"] * (len(CLASHING) + 4)) for r in rows], f"doc_id long, text string, lang string, {extra}")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def cases(n: int = 400):
    r = random.Random(3)
    texts = [None, "", "short text", "SHOUTED WORDS " * 150, "again " * 300, " ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(250)) + " #tag", "É" * 50]
    rows = [(r.choice([None, *range(n)]), r.choice(texts), r.choice([None, "", "en", "de"])) for _ in range(n)]
    rows += [(5, "same", "en"), (5, "same", "en"), (n, "same", "fr"), (n + 1, " ".join(f"long{k}" for k in range(60_000)), "en")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, n, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (n + 99, 1, 1)]
    return rows, labels


def test_sql(spark):
    same_rows(spark, QUERIES["op13_filter_audit"], ORACLES["op13_filter_audit"], f"{TESTDATA}/sf0.01")


def test_brute_force(spark):
    rows, labels = cases()
    docs, marks = tables(spark, rows, labels)
    assert result(filter_audit(docs, marks)) == brute(rows, labels)


def test_groups_of_copies_over_many_partitions(spark):
    # One text makes up most rows, so that it lies in several partitions; some are wholly of it.
    rows = [(k, "the same words" if k % 10 else f"other {k}", "en") for k in range(4000, 0, -1)]
    docs, _ = tables(spark, rows, [])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = masks(docs.repartition(3), Tables(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 4000
    assert {r["doc_id"] for r in found if r["mask"] & 16 == 0} == {1, *range(10, 4001, 10)}


def test_small_arrow_batches(spark):
    rows, _ = cases(60)
    docs, _ = tables(spark, rows, [])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = sorted(((r["doc_id"] is None, r["doc_id"], r["part"], r["mask"]) for r in masks(docs, Tables(spark)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    bits = {k: 1 << n for n, k in enumerate("ABCDE")}
    assert found == sorted(((i is None, i, lang or "", sum(bits[k] for k in f)) for (i, _, lang), f in zip(rows, failures(rows))), key=str)


def test_ids_of_any_type_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en"), (None, "x", "en")], "doc_id string, text string, lang string")
    assert {r["doc_id"]: r["mask"] & 16 for r in masks(docs, Tables(spark)).collect()} == {"a": 0, "b": 16, None: 0}
    docs, marks = tables(spark, [], [])
    assert filter_audit(docs, marks).count() == 0


def test_production_rows(spark):
    folder = f"{TESTDATA}/sf0.001"
    rows = [tuple(r) for r in read(spark, folder, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in read(spark, folder, "labels").select("doc_id", "quality", "toxic").collect()]
    found = QUERIES["op13_filter_audit"](spark, folder)
    assert dict(found.dtypes)["step"] == "int" and {t for c, t in found.dtypes if c in (*COLUMNS, "shapley")} == {"bigint"}
    assert result(found) == brute(rows, labels)
    assert found.groupBy("part").agg(F.count("*").alias("n")).where("n <> 600").isEmpty()
