"""The event log folded into the state of each page's stage, the same however the log is cut into batches.

Events may come late by up to a ``delay``.  They wait in the key's state until the watermark has passed them, and are
then applied in order of their time and number, all that are due at one call of their key, so a state doesn't depend on
which trigger brought an event.  Keys that nothing happened to for ``idle`` of event time give up their state; an event after that starts anew, with the
count of changes at its first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("project_id", "page_no", "stage_ord")
STATE = "project_id string, page_no int, stage_ord int, status string, seq long, changes int, events int"
#: Spark's setting for a state store that keeps several values for a key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold(StatefulProcessor):
    """Waiting events and the last state of one key."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, status string")
        self.state = handle.getValueState("state", "status string, seq long, changes int, events int, at long")

    def _wake(self, at: int) -> None:
        """The key's only timer, at the first moment that something is due."""
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            # In microseconds, which tell the order; timers are in milliseconds.
            at = (frame["ts"].astype("int64") // (1000 if "ns" in str(frame["ts"].dtype) else 1)).tolist()
            new += zip(at, frame["seq"].tolist(), frame["status"].tolist(), strict=True)
        if new:
            # The event that wakes the key is due before all others that wait, and before the state idles.
            first = min(new)[0] // 1000
            timers = list(self.handle.listTimers())
            self.waiting.appendList(new)
            if not timers or first < min(timers):
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(e for e in held if e[0] // 1000 <= now)
        status, seq, changes, events, before = self.state.get() if self.state.exists() else (None, -1, 0, 0, None)
        shown: list[tuple] = []
        for n, (at, number, new) in enumerate(due):
            if before is not None and before // 1000 + self.idle_ms <= at // 1000:
                status, seq, changes, events = None, -1, 0, 0
            changes, events = changes + (new != status), events + 1
            status, seq, before = new, number, at
            # Events of one moment are one step.
            if n + 1 == len(due) or due[n + 1][0] != at:
                shown.append((*key, status, seq, changes, events))
        rest = [e for e in held if e[0] // 1000 > now]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if before is not None and before // 1000 + self.idle_ms <= now:
            self.state.clear()
            before = None
        elif due:
            self.state.update((status, seq, changes, events, before))
        moments = ([min(rest)[0] // 1000] if rest else []) + ([before // 1000 + self.idle_ms] if before is not None else [])
        if moments:
            self.handle.registerTimer(min(moments))
        if shown:
            yield pd.DataFrame(shown, columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def states(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 10**15) -> DataFrame:
    """Each state that a key had, once no earlier event can come; ``events``: a stream with the key, ts, seq, status."""
    timed = events.select(*KEY, F.col("ts").cast("timestamp").alias("ts"), "seq", "status").withWatermark("ts", delay)
    return timed.groupBy(*KEY).transformWithStateInPandas(Fold(idle_ms), STATE, "Append", "EventTime")


def states_in_batch(events: DataFrame, idle_ms: int = 10**15) -> DataFrame:
    """The last state of each key of a whole log, as the stream leaves it."""
    order = Window.partitionBy(*KEY).orderBy("ts", "seq")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    anew = F.coalesce(ms - F.lag(ms).over(order) >= idle_ms, F.lit(False))
    changed = anew | F.coalesce(F.lag("status").over(order) != F.col("status"), F.lit(True))
    rows = events.select(*KEY, "ts", "seq", "status", anew.cast("int").alias("anew"), changed.cast("int").alias("changed")).withColumn("life", F.sum("anew").over(order))
    last = rows.groupBy(*KEY, "life").agg(F.max_by(F.struct("status", "seq"), F.struct("ts", "seq")).alias("s"), F.sum("changed").cast("int").alias("changes"), F.count("*").cast("int").alias("events"))
    newest = last.groupBy(*KEY).agg(F.max_by(F.struct("s", "changes", "events"), "life").alias("e"))
    return newest.select(*KEY, "e.s.status", "e.s.seq", "e.changes", "e.events")
