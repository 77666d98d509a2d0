from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from quire.operators import drift, pagemodels, stages, words

KEY = ["project_id", "page_no", "stage_ord"]


def test_reset_rerun_and_purge(spark):
    states = spark.createDataFrame([("p", 1, 1, "clean", "h", 5), ("p", 1, 2, "failed", "i", 6), ("q", 1, 1, "clean", "h", 7)], "project_id string, page_no int, stage_ord int, status string, input_hash string, seq int")
    found = {(r.project_id, r.stage_ord): (r.status, r.input_hash, r.seq) for r in stages.reset(stages.rerun(states, F.col("stage_ord") == 1), F.col("stage_ord") == 2, KEY).collect()}
    assert found == {("p", 1): ("dirty", "h", 5), ("p", 2): ("not-run", None, None), ("q", 1): ("dirty", "h", 7)}
    files = spark.createDataFrame([("p", "/projects/p/pages/1/stages/a/x", 3), ("p", "/projects/p/pages/1/stages/b/y", 4), ("p", "/projects/p/source/z", 5), ("q", "/projects/q/pages/1/stages/a/x", 6)], "project_id string, path string, size int")
    after, left, gone = stages.purge(states, files, spark.createDataFrame([("p",), ("p",), ("nobody",)], "project_id string"), KEY)
    assert {(r.project_id, r.stage_ord): (r.status, r.seq) for r in after.collect()} == {("p", 1): ("not-run", None), ("p", 2): ("not-run", None), ("q", 1): ("clean", 7)}
    assert {r.path for r in left.collect()} == {"/projects/p/source/z", "/projects/q/pages/1/stages/a/x"} and [tuple(r) for r in gone.collect()] == [("p", 2, 7)]


def test_unsplit(spark):
    pages = spark.createDataFrame([("p", 0, None), ("p", 1, 0), ("p", 2, 0), ("p", 3, 9), ("q", 1, 0)], "project_id string, idx0 int, parent_idx0 int")
    left, states = stages.unsplit(pages, pages.select("project_id", "idx0").crossJoin(spark.range(2)), spark.createDataFrame([("p", 0), ("p", 0)], "project_id string, parent_idx0 int"))
    assert {(r.project_id, r.idx0) for r in left.collect()} == {("p", 0), ("p", 3), ("q", 1)}
    assert states.count() == 6 and states.where("project_id = 'p' and idx0 in (1, 2)").isEmpty()


def test_quarantine(spark):
    orphans = spark.createDataFrame([("p", "1", "ocr", "no-row", "projects/p/pages/1/a.png"), ("p", "1", "ocr", "extra-file", "projects/p/pages/1/b.png"), ("p", "2", "ocr", "no-row", "elsewhere/c.png"), ("q", "1", "ocr", "no-row", "projects/q/pages/1/a.png")], "project_id string, page_id string, stage_id string, reason string, path string")
    q = "projects/p/.orphan-stage-artifacts"
    taken = spark.createDataFrame([("p", f"{q}/pages/1/a.png"), ("p", f"{q}/pages/1/a.png.1"), ("p", f"{q}/pages/1/a.png.3"), ("p", f"{q}/pages/1/b.png.1")], "project_id string, path string")
    found = {r["from"]: (r["to"], json.loads(r["line"])) for r in drift.quarantined(orphans, taken).collect()}
    assert {k: v[0] for k, v in found.items()} == {"projects/p/pages/1/a.png": f"{q}/pages/1/a.png.2", "projects/p/pages/1/b.png": f"{q}/pages/1/b.png", "elsewhere/c.png": f"{q}/elsewhere/c.png", "projects/q/pages/1/a.png": "projects/q/.orphan-stage-artifacts/pages/1/a.png"}
    assert found["elsewhere/c.png"][1] == {"project_id": "p", "page_id": "2", "stage_id": "ocr", "reason": "no-row", "from": "elsewhere/c.png", "to": f"{q}/elsewhere/c.png"}


def test_counts_texts_and_durations(spark):
    flags = spark.createDataFrame([("p", "open"), ("p", "accepted"), ("q", "rejected")], "project_id string, status string")
    assert {tuple(r) for r in words.open_counts(flags, ["project_id"]).collect()} == {("p", 1, 2), ("q", 0, 1)}
    joined, passed = (spark.createDataFrame(rows, "k int, text string") for rows in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (9, "d")]))
    assert {tuple(r) for r in pagemodels.reviewed_texts(joined, passed, ["k"]).collect()} == {(1, "a", "{}"), (2, "c", "{}"), (3, None, "{}")}
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at, at + dt.timedelta(milliseconds=1500)), (at, None), (at, at - dt.timedelta(seconds=1))], "a timestamp, b timestamp")
    assert [r[0] for r in rows.select(pagemodels.duration_ms(F.col("a"), F.col("b"))).collect()] == [1500, None, 0]
