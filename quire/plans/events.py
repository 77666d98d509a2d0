"""Queries over images and the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import images as I
from quire.registry import query
from quire.streaming import events as E
from quire.streaming import fold
from quire.tables import shared_folder, table


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """An embedding as eight rows of eight gray pixels."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x.cast("double") * 100 + 128))))
    hexed = F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), "")
    return table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(hexed).alias("data"))


_PIX = "SELECT vec_id, list_transform(embedding, lambda x: greatest(0.0, least(255.0, floor(CAST(x AS DOUBLE) * 100 + 128)))) AS v FROM embeddings"


@query(f"SELECT vec_id, ROUND(list_avg(v), 4) AS mean_luma, CASE WHEN list_avg(v) >= 245 THEN 'blank' ELSE 'normal' END AS page_type FROM ({_PIX})")
def image_signals(spark: SparkSession, d: str) -> DataFrame:
    return I.measure(_pixels(spark, d), "vec_id").select("vec_id", F.round("mean_luma", 4).alias("mean_luma"), I.suggestion()[0])


@query(f"SELECT vec_id, 8 AS height, 8 AS width, CAST(len(list_filter(v, lambda x: x > 128)) AS INT) AS white FROM ({_PIX})")
def thresholded_images(spark: SparkSession, d: str) -> DataFrame:
    """Fixed threshold after a flip, in one pass; the number of white pixels."""
    done = I.chain(_pixels(spark, d), "vec_id", [lambda x: I.flip(x, horizontal=True), lambda x: I.threshold(x, 128)])
    return done.select("vec_id", "height", "width", ((F.length(F.hex("data")) - F.length(F.replace(F.hex("data"), F.lit("F"), F.lit("")))) / 2).cast("int").alias("white"))


@query(oracle("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, project_id, COUNT(*) AS events, CAST(COUNT(*) FILTER (status = 'failed') AS BIGINT) AS failed FROM fx_page_stages GROUP BY ALL", "fx_page_stages"))
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the event log, in batch; the streaming form is the same function."""
    return E.windowed(fx.page_stages(spark, d), "1 hour").select("start", "project_id", "events", "failed")


@query(oracle("SELECT project_id, MIN(ts) AS start, COUNT(*) AS events FROM (SELECT *, SUM(n) OVER (PARTITION BY project_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY project_id ORDER BY ts, seq) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS n FROM fx_page_stages)) GROUP BY project_id, s", "fx_page_stages"))
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(fx.page_stages(spark, d), "20 minutes").select("project_id", "start", "events")


_FOLDED = """SELECT project_id, page_no, stage_ord, arg_max(status, k) AS status, arg_max(seq, k) AS seq, CAST(COUNT(*) FILTER (before IS DISTINCT FROM status) AS INT) AS changes, CAST(COUNT(*) AS INT) AS events
FROM (SELECT *, row_number() OVER w AS k, lag(status) OVER w AS before FROM {rows} WINDOW w AS (PARTITION BY project_id, page_no, stage_ord ORDER BY ts, seq)) GROUP BY project_id, page_no, stage_ord"""


@query(oracle(_FOLDED.format(rows="fx_page_stages"), "fx_page_stages"))
def folded_states(spark: SparkSession, d: str) -> DataFrame:
    """The log folded into the last state of each key, with the number of changes and events, in batch."""
    return fold.states_in_batch(fx.page_stages(spark, d))


@query(oracle(_FOLDED.format(rows="(SELECT * FROM fx_page_stages WHERE epoch_ms(ts) <= (SELECT MAX(epoch_ms(ts)) - 3600000 FROM fx_page_stages))"), "fx_page_stages"))
def streamed_states(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream over the log, as far as its watermark has come, an hour behind the last event."""
    rows, before = fx.page_stages(spark, d), spark.conf.get(fold.STORE[0], None)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/log")
    spark.conf.set(*fold.STORE)
    try:
        found = fold.states(E.read(spark, f"{folder}/log", rows.schema, 1000), "1 hour")
        found.writeStream.format("parquet").option("path", f"{folder}/states").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(fold.STORE[0]) if before is None else spark.conf.set(fold.STORE[0], before)
    held = spark.read.schema(fold.STATE).parquet(f"{folder}/states")
    return held.groupBy(*fold.KEY).agg(F.max_by(F.struct("status", "seq", "changes", "events"), "events").alias("s")).select(*fold.KEY, "s.*")
