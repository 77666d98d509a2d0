from __future__ import annotations

from quire.operators import numbering as N

LEAF = "project_id string, scan int, leaf_role string, run_id string, ocr_folio string"
RUN = "project_id string, run_pos int, run_id string, style string, start_mode string, start_no int, step_no int, lo int, hi int"


def leaves(spark, rows):
    return spark.createDataFrame([("p", k, role, run, folio) for k, (role, run, folio) in enumerate(rows)], LEAF)


def by_scan(frame, column):
    return [r[column] for r in frame.orderBy("scan").collect()]


def test_blank_pages_count_and_markers_do_not(spark):
    runs = spark.createDataFrame([("p", 0, "r", "arabic", "set", 1, 1, 0, 9)], RUN)
    found = N.labels(leaves(spark, [("text", "r", None), ("blank", "r", None), ("blank", None, None), ("text", "r", "7"), ("plate", "r", None)]), runs)
    assert by_scan(found, "label") == ["1", "2", "[Blank Page]", "3", "—"]
    assert by_scan(N.reconcile(found), "out_of_sequence") == [False, False, False, True, False]


def test_continued_runs(spark):
    runs = spark.createDataFrame([("p", 0, "a", "roman-lower", "set", 1, 1, 0, 1), ("p", 1, "b", "arabic", "continue", 9, 1, 2, 9), ("p", 2, "c", "none", "set", 1, 1, None, None)], RUN)
    found = N.ordinals_with_continue(leaves(spark, [("text", "a", None), ("text", "a", None), ("text", "b", None), ("plate", "b", None), ("text", "b", None), ("text", None, None), ("text", "c", None)]), runs)
    assert by_scan(found, "ordinal") == [1, 2, 3, None, 4, None, 1]


def test_continued_fold_agrees_with_windows_where_all_runs_set_their_start(spark):
    from quire import fixtures as fx

    d = "/root/testdata/sf0.001"
    a = {(r["project_id"], r["scan"]): r["ordinal"] for r in N.ordinals(fx.leaves(spark, d), fx.runs(spark, d)).collect()}
    b = {(r["project_id"], r["scan"]): r["ordinal"] for r in N.ordinals_with_continue(fx.leaves(spark, d), fx.runs(spark, d)).collect()}
    assert a == b


def test_prefixes(spark):
    runs = spark.createDataFrame([("p", 0, "f", "roman-lower", "set", 1, 1, 0, 1), ("p", 1, "b", "arabic", "set", 1, 1, 2, 5)], RUN)
    six = [("text", "f", None)] * 2 + [("text", "b", None)] * 4
    assert by_scan(N.prefixes(leaves(spark, six), runs), "prefix") == ["000f001", "001f002", "002p001", "003p002", "004p003", "005p004"]
    cover = [("cover", None, None), ("text", "f", None), ("text", "b", None), ("plate", None, None), ("text", "b", None), ("skip", None, None)]
    assert by_scan(N.prefixes(leaves(spark, cover), runs), "prefix") == ["000e", "001f001", "002p001", "003pb", "004p002", None]


def test_empty(spark):
    runs = spark.createDataFrame([], RUN)
    assert N.manifest(leaves(spark, []), runs).count() == 0
    assert by_scan(N.labels(leaves(spark, [("text", "r", None)]), runs), "label") == [""]


def test_numbering_goes_on_in_time_in_proportion_to_the_leaves(spark):
    """A hundred thousand leaves of one project: the second run continues the first's last number."""
    import time

    from pyspark.sql import functions as F

    from quire.operators import numbering

    runs = spark.createDataFrame([("p", 0, "front", "arabic", "set", 5, 2, 0, 3), ("p", 1, "body", "arabic", "continue", 1, 1, 4, 9)], "project_id string, run_pos int, run_id string, style string, start_mode string, start_no int, step_no int, lo int, hi int")
    leaves = spark.range(100_000).select(F.lit("p").alias("project_id"), F.col("id").cast("int").alias("scan"), F.when(F.col("id") % 10 == 9, "plate").otherwise("text").alias("leaf_role"), F.when(F.col("id") < 50_000, "front").otherwise("body").alias("run_id"))
    started = time.monotonic()
    found = {r.scan: r.ordinal for r in numbering.ordinals_with_continue(leaves, runs).collect()}
    assert time.monotonic() - started < 40
    assert found[0] == 5 and found[8] == 21 and found[9] is None and found[10] == 23
    assert found[49_998] == 5 + 2 * 44_999 and found[50_000] == found[49_998] + 1 and found[99_998] == found[49_998] + 45_000
