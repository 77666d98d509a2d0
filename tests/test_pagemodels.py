from __future__ import annotations

import itertools
import json

from pyspark.sql import functions as F

from quire.operators import listing
from quire.operators import pagemodels as M

PAGES = "project_id string, idx0 int, page_type string, splits array<string>, processing_status string, outputs array<struct<status:string,error:string>>"


def test_filters_combine(spark):
    kinds = itertools.product(("normal", "blank"), (None, [], ["a"]), ("complete", "error", None), (None, [], [("complete", None)], [("running", None)], [("complete", "bad")]))
    rows = [("p", k, *x) for k, x in enumerate(kinds)]
    frame = spark.createDataFrame(rows, PAGES)
    review = lambda r: r[4] == "error" or any(s != "complete" or e is not None for s, e in r[5] or [])
    for page_type, splits, status, needed in itertools.product((None, "blank"), (None, True, False), (None, "error"), (None, True, False)):
        want = {r[1] for r in rows if page_type in (None, r[2]) and splits in (None, bool(r[3])) and status in (None, r[4]) and needed in (None, review(r))}
        assert {r.idx0 for r in M.filtered(frame, page_type, splits, status, needed).select("idx0").collect()} == want
    assert M.split_sources(frame).count() == sum(bool(r[3]) for r in rows)


def test_crop_rows_fall_back_to_the_number(spark):
    pages = spark.createDataFrame([("p", 4, "a1", [1, 2, 3, 4]), ("p", 7, "a2", None), ("p", 9, "", None), ("p", 11, None, None), ("q", 4, "a1", None)], "project_id string, idx0 int, prefix string, source_crop_bbox array<int>")
    states = spark.createDataFrame([("p", "a1", "crop", "failed"), ("p", "0004", "crop", "dirty"), ("p", "0007", "crop", "dirty"), ("p", "0009", "crop", "clean"), ("p", "0011", "ocr", "failed")], "project_id string, page_id string, stage string, status string")
    found = {(r.project_id, r.n): (r.page_id, r.flags, r.bbox) for r in M.crop_rows(pages, states, "crop").collect()}
    assert found == {("p", 0): ("a1", ["error"], [1, 2, 3, 4]), ("p", 1): ("a2", ["stale"], None), ("p", 2): ("0009", [], None), ("p", 3): ("0011", [], None), ("q", 0): ("a1", [], None)}


def test_records_have_all_fields(spark):
    row = M.records(spark.createDataFrame([("p", 1, "x", "k", 5)], "project_id string, idx0 int, prefix string, source_key string, other int")).first()
    assert tuple(row.__fields__) == M.RECORD and (row.project_id, row.idx0, row.prefix, row.source_key, row.splits) == ("p", 1, "x", None, None)


def test_artifacts_and_keys(spark):
    frame = spark.createDataFrame([("gray", "p1", "projects/p1/x"), ("words+text", "p1", "//projects/p1/x"), (None, "p1", "projects/p1x/y"), ("odd", "p1", None)], "kind string, p string, k string")
    name, error = M.artifact_file(F.col("kind"))
    assert [(r.n, bool(r.e), bool(r.k)) for r in frame.select(name.alias("n"), error.alias("e"), M.key_error(F.col("p"), F.col("k")).alias("k")).collect()] == [("output.png", False, False), ("words.json", False, False), (None, True, True), (None, True, True)]


def test_queued_jobs_and_results(spark):
    jobs = spark.createDataFrame([(k, "queued" if k % 2 else "done", 9 - k) for k in range(9)], "job_id int, status string, created int")
    assert [r.job_id for r in M.queued(jobs, 2).collect()] == [7, 5]
    items = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", [])], "job_id string, items array<string>")
    results = spark.createDataFrame([("a", [1, 2]), ("b", [1, 2])], "job_id string, results array<int>")
    found = [(r.job_id, r.place, r.item, r.result, bool(r.error)) for r in M.with_results(items, results).orderBy("job_id", "place").collect()]
    assert found == [("a", 0, "x", 1, False), ("a", 1, "y", 2, False), ("b", None, None, None, True), ("c", None, None, None, False)]


def test_naming_blockers(spark):
    rows = [("p", 0, "much_too_long"), ("p", 1, "bad name"), ("p", 2, "fine"), ("p", 3, "Ad"), ("q", 0, "a"), ("q", 1, "b"), ("r", 0, "b"), ("r", 1, "a")]
    found = {r.project_id: r.message for r in M.naming_blockers(spark.createDataFrame(rows, "project_id string, pos int, prefix string")).collect()}
    # Each page makes two files.
    said = ["basename_too_long:'much_too_long' has 13 chars (max 8)"] * 2
    said += ["invalid_chars:'bad name' contains characters outside [A-Za-z0-9_-]", "ad_substring:'bad name' contains the substring 'ad' (ad-blocker risk)"] * 2
    said += ["ad_substring:'Ad' contains the substring 'ad' (ad-blocker risk)"] * 2 + ["sort_order"]
    assert found == {"p": "PGDP naming violations: " + "; ".join(said), "r": "PGDP naming violations: sort_order"}


def test_manifest_round_trip(spark):
    rows = [("p", 1, 0, "cover", "cover", "000e", "", None), ("p", 0, 3, "normal", "text", "001p001", "1", "body"), ("p", 2, 1, "skip", "skip", None, "", None), ("p", 3, 2, "blank", "blank", None, "[Blank Page]", None)]
    frame = spark.createDataFrame(rows, "project_id string, pos int, scan int, page_type string, leaf_role string, prefix string, label string, run_id string")
    told = json.loads(M.naming_manifest(frame, numeric=True).first().manifest)
    assert told["version"] == 2 and told["skip_ids"] == ["0001"]
    assert [(e["page_id"], e["idx0"], e["role"], e["prefix"], e["export_name"], e["label"], e["run_id"]) for e in told["pages"]] == [("0003", 3, "normal", "001p001", "000", "1", "body"), ("0000", 0, "cover", "000e", "001", "", None), ("0001", 1, "skip", None, None, "", None), ("0002", 2, "blank", None, None, "[Blank Page]", None)]
    assert all(e["export_name"] is None for e in json.loads(M.naming_manifest(frame).first().manifest)["pages"])


def test_manifests_and_runs_of_several_kinds(spark):
    found = spark.createDataFrame([("ok", '{"version":2,"pages":[{"page_id":"0001","idx0":1,"role":"x","extra":1}],"skip_ids":["0002"]}'), ("old", '{"version":1}'), ("none", "{}"), ("cut", '{"version":2,"pa')], "project_id string, manifest string")
    projects = spark.createDataFrame([(p,) for p in ("ok", "old", "none", "cut", "gone")], "project_id string")
    got = {r.project_id: r for r in M.parsed_manifests(found, projects).collect()}
    assert got["ok"].error is None and got["ok"].pages[0].idx0 == 1 and got["ok"].skip_ids == ["0002"]
    assert {p: r.error for p, r in got.items() if p != "ok"} == {"old": "version 1 is not supported", "none": "version 0 is not supported", "cut": "unreadable", "gone": "not found"}
    runs = spark.createDataFrame([("ok", '{"runs":[{"id":"a","span":[0,3]},{"id":"b","style":"roman-lower","start":5,"span":null}]}'), ("old", '[{"id":"a"}]'), ("none", "{}"), ("cut", '{"runs":[{"style":"arabic"}]}')], "project_id string, runs string")
    found = [(r.project_id, r.run_pos, r.run_id, r.style, r.start, r.step, r.role, r.lo, r.hi) for r in M.parsed_runs(runs, projects).orderBy("run_pos").collect()]
    assert found == [("ok", 0, "a", "arabic", 1, 1, "text", 0, 3), ("ok", 1, "b", "roman-lower", 5, 1, "text", None, None)]


def test_confirmations_waivers_gates(spark):
    events = spark.createDataFrame([("p", "ocr", 1, "x", True), ("p", "ocr", 3, "y", False), ("p", "zip", 2, "z", True), ("p", "zip", 1, "z", False)], "project_id string, stage string, seq int, actor_id string, confirmed boolean")
    assert [(r.stage, r.seq) for r in M.confirmations(events).collect()] == [("zip", 2)]
    blockers = spark.createDataFrame([("p", "1", "a"), ("p", "2", "a"), ("p", None, "b"), ("q", "1", "a")], "project_id string, page_id string, code string")
    waivers = spark.createDataFrame([("p", "a", None, 1, "all"), ("p", "a", "1", 2, "own"), ("p", "a", "1", 1, "older"), ("p", "b", None, 1, "b")], "project_id string, code string, page_id string, seq int, reason string")
    assert {(r.project_id, r.page_id, r.code): r.reason for r in M.waived(blockers, waivers).collect()} == {("p", "1", "a"): "own", ("p", "2", "a"): "all", ("p", None, "b"): "b", ("q", "1", "a"): None}
    gates = spark.createDataFrame([("p", "submit", [], 5), ("q", "submit", ["ocr"], 5)], "project_id string, stage string, missing array<string>, at int")
    assert [tuple(r) for r in M.gate_event(gates, "me").collect()] == [("p", "submit", "GateConfirmed", "me", 5)]


def test_zones_as_object_or_list(spark):
    pages = spark.createDataFrame([("p", k) for k in range(4)], "project_id string, idx0 int")
    states = spark.createDataFrame([("p", 0, "clean", '{"zones":[{"zone_id":"a","bbox":[1,2,3,4]},{"zone_id":"b"}],"image_width":5}'), ("p", 1, "clean", '[{"zone_id":"a"}]'), ("p", 2, "clean", "{"), ("p", 3, "dirty", '{"zones":[]}')], "project_id string, idx0 int, status string, zones string")
    assert {r.idx0: (r.state, r.zones) for r in listing.zone_rows(pages, states).collect()} == {0: ("reviewed", 2), 1: ("reviewed", 1), 2: ("reviewed", None), 3: ("flagged", None)}
