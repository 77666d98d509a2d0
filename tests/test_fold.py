from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quire.streaming import events as E
from quire.streaming import fold

SCHEMA = "project_id string, page_no int, stage_ord int, status string, seq long, ts timestamp"
START = dt.datetime(2024, 1, 1)


def log(n: int = 400):
    """Events in the order in which they arrive: up to an hour late."""
    r = random.Random(7)
    rows = [("p", k % 3, r.randrange(2), r.choice(["clean", "dirty", "failed"]), k, START + dt.timedelta(minutes=5 * k, seconds=r.randrange(60))) for k in range(n)]
    return sorted(rows, key=lambda e: (e[5] + dt.timedelta(minutes=r.randrange(60)), e[4]))


def streamed(spark, rows, cuts: int, folder, idle_ms: int):
    folder.mkdir()
    size = -(-len(rows) // cuts)
    for k in range(cuts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "log"))
    stream = E.read(spark, str(folder / "log"), spark.createDataFrame([], SCHEMA).schema)
    name = f"fold_{folder.name}"
    query = fold.states(stream, "1 hour", idle_ms).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return {(r.project_id, r.page_no, r.stage_ord, r.status, r.seq, r.changes, r.events) for r in spark.table(name).groupBy(*fold.KEY).agg(F.max_by(F.struct("status", "seq", "changes", "events"), "seq").alias("s")).select(*fold.KEY, "s.*").collect()}


@pytest.fixture
def store(spark):
    before = spark.conf.get(fold.STORE[0], None)
    spark.conf.set(*fold.STORE)
    yield
    spark.conf.unset(fold.STORE[0]) if before is None else spark.conf.set(fold.STORE[0], before)


@pytest.mark.parametrize("idle_ms", [10**15, 45 * 60_000])
def test_the_cut_of_the_log_does_not_matter(spark, store, tmp_path, idle_ms):
    rows = log()
    passed = max(r[5] for r in rows) - dt.timedelta(hours=1)
    batch = fold.states_in_batch(spark.createDataFrame([r for r in rows if r[5] <= passed], SCHEMA), idle_ms)
    want = {tuple(r) for r in batch.select(*fold.KEY, "status", "seq", "changes", "events").collect()}
    for cuts in (1, 9):
        assert streamed(spark, rows, cuts, tmp_path / f"cut{cuts}", idle_ms) == want
    # What idles for long starts anew, so fewer events are counted.
    total = sum(r[6] for r in want)
    assert total == sum(r[5] <= passed for r in rows) if idle_ms == 10**15 else total < 300


class Held:
    """A state of one key, and the handle with its timers."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.registerTimer, self.deleteTimer, self.listTimers = self.timers.add, self.timers.remove, lambda: iter(self.timers)
        self.parts = {}

    def part(self, name, schema):
        return self.parts.setdefault(name, Held())

    getListState = getValueState = part

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def appendValue(self, one):
        self.value = [*(self.value or []), one]

    def appendList(self, more):
        self.value = [*(self.value or []), *more]

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


def test_a_key_is_woken_once_for_all_that_is_due():
    held, one = Held(), fold.Fold(10**15)
    one.init(held)
    frame = pd.DataFrame({"ts": [START + dt.timedelta(seconds=k) for k in range(1000)], "seq": range(1000), "status": [f"s{k % 3}" for k in range(1000)]})
    assert list(one.handleInputRows(("p", 1, 1), iter([frame[500:], frame[:500]]), None)) == []
    start = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert held.timers == {start}
    held.timers.clear()
    (shown,) = one.handleExpiredTimer(("p", 1, 1), TimerValues(-1, start + 899_000), ExpiredTimerInfo(start))
    assert [tuple(r) for r in shown.itertuples(index=False)] == [("p", 1, 1, f"s{k % 3}", k, k + 1, k + 1) for k in range(900)]
    assert held.timers == {start + 900_000} and len(held.parts["waiting"].get()) == 100


def test_time_within_a_millisecond_goes_before_the_number():
    held, one = Held(), fold.Fold(10**15)
    one.init(held)
    frame = pd.DataFrame({"ts": [START + dt.timedelta(microseconds=m) for m in (900, 100)], "seq": [1, 2], "status": ["last", "first"]})
    assert list(one.handleInputRows(("p", 1, 1), iter([frame]), None)) == []
    (at,) = held.timers
    (shown,) = one.handleExpiredTimer(("p", 1, 1), TimerValues(-1, at), ExpiredTimerInfo(at))
    assert shown["status"].tolist() == ["first", "last"] and shown["events"].tolist() == [1, 2]
