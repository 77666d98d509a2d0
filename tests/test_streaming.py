from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.operators import stages
from quire.operators.listing import job_rollup
from quire.streaming import events as E

FOLDER = "/root/testdata/sf0.001"


def log(spark, tmp_path):
    """The event log in three files, read one file a trigger."""
    rows = fx.page_stages(spark, FOLDER).where("page_no < 4 and stage_ord < 4")
    for k in range(3):
        rows.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return rows, E.read(spark, str(tmp_path / "log"), rows.schema)


def test_state_by_key_is_the_latest_row(spark, tmp_path):
    rows, stream = log(spark, tmp_path)
    query = E.stage_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = ["project_id", "page_no", "stage_ord"]
    got = {(r.project_id, r.page_no, r.stage_ord): (r.status, r.seq) for r in stages.latest(spark.table("states"), key, "seq").collect()}
    wanted = {(r.project_id, r.page_no, r.stage_ord): (r.status, r.seq) for r in stages.latest(rows, key, "seq").collect()}
    assert got == wanted and wanted


def test_dispatch_flushes_every_result_once(spark, tmp_path):
    rows, stream = log(spark, tmp_path)
    shape = lambda f: f.select(F.col("project_id").alias("job_id"), F.col("seq").alias("pos"), (F.col("status") != "failed").alias("ok"), F.col("status").alias("error"))
    flushed = []
    E.dispatch(shape(stream), lambda batch, n: flushed.extend(batch.collect()), checkpoint=str(tmp_path / "c")).awaitTermination(120)
    total = {}
    for r in flushed:
        a, b = total.get(r.job_id, (0, 0))
        total[r.job_id] = (a + r.ok, b + r.errors)
    assert total == {r.job_id: (r.ok, r.errors) for r in job_rollup(shape(rows)).collect()}


def test_windows_agree_with_batch(spark, tmp_path):
    rows, stream = log(spark, tmp_path)
    query = E.windowed(stream, "1 hour", late="400 days").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, E.windowed(rows, "1 hour").collect()))
