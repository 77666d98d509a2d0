"""Event streams: stage state by key, batches of jobs, event-time windows.

The batch forms of these are ``stages.latest`` and ``listing.job_rollup``; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quire.operators.listing import job_rollup

STATE = "project_id string, page_no int, stage_ord int, status string, seq long, changes int"


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """An append-only log of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stage_states(events: DataFrame) -> DataFrame:
    """The state of each page's stage after each batch that changed it: the event with the largest ``seq`` counts, late ones don't."""

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq, changes = state.get if state.exists else (None, -1, 0)
        for frame in frames:
            at = frame["seq"].idxmax()
            if frame["seq"][at] > seq:
                changes += int(frame["status"][at] != status)
                status, seq = frame["status"][at], int(frame["seq"][at])
        state.update((status, seq, changes))
        yield pd.DataFrame({"project_id": [key[0]], "page_no": [key[1]], "stage_ord": [key[2]], "status": [status], "seq": [seq], "changes": [changes]})

    grouped = events.select("project_id", "page_no", "stage_ord", "status", "seq").groupBy("project_id", "page_no", "stage_ord")
    return grouped.applyInPandasWithState(fold, STATE, "status string, seq long, changes int", "update", GroupStateTimeout.NoTimeout)


def dispatch(results: DataFrame, flush: Callable[[DataFrame, int], None], every: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Collects results for an interval, then hands each batch's roll-up by job to ``flush``; without an interval, what is there at once."""
    writer = results.writeStream.foreachBatch(lambda batch, n: flush(job_rollup(batch), n))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def drain(jobs: DataFrame, handle: Callable[[DataFrame, int], None], window: str = "200 milliseconds") -> StreamingQuery:
    """Jobs of each collection window in order of priority and arrival."""
    return jobs.writeStream.foreachBatch(lambda batch, n: handle(batch.orderBy("priority", "seq"), n)).trigger(processingTime=window).start()


def fan_out(events: DataFrame, channel: str) -> DataFrame:
    """The part of a stream that a channel gets: ``project`` or ``project/page``."""
    return events.where((F.col("project_id") == channel) | (F.concat_ws("/", "project_id", F.col("page_no").cast("string")) == channel))


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need an instant; a log without time zone is read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and failures by event-time window; later ones than the watermark are left out."""
    out = _timed(events, late).groupBy(F.window("ts", width, slide or width), "project_id").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "project_id", "events", "failed")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of one project without a gap."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap), "project_id").agg(F.count("*").alias("events"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "project_id", "events")
