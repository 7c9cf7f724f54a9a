"""Keyed state of the streaming jobs, in Spark's state store.

A processor sees the rows of one key and that key's state only, so a micro-batch
costs what its own keys cost. State is kept by RocksDB on the executors, with a log
of changes in the query's checkpoint; Spark itself removes old versions. Event-time
timers end what a key remembers.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

FIRST_ROW = "cache_key string, request_id long, ts timestamp, confidence double"
LOG_ROW = "event_id long, ts timestamp, run_id string, status string"
MARK = -1  # event_id of a row that only moves the watermark
CHANGE_ROW = "event_id long, run_id string, status string, prev_status string"

_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The settings that a query with keyed state starts with; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _millis(ts: pd.Timestamp) -> int:
    """The first whole millisecond at or after a time; timers count in milliseconds."""
    return -(-ts.value // 1_000_000)


def _utc(ts: dt.datetime) -> dt.datetime:
    """A time with its zone: batches give it in UTC, the state store in the worker's local time without a zone."""
    return ts.astimezone(dt.timezone.utc)


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of an Arrow batch, the first row of each key and the newest row, which the watermark needs.

    A key that holds most of the rows is thinned here, before rows move to their key's task.
    """
    for batch in batches:
        rows = pa.Table.from_batches([batch]).to_pandas()
        if len(rows):
            ordered = rows.sort_values(["ts", "request_id"], kind="stable")
            kept = pd.concat([ordered.drop_duplicates("cache_key"), ordered.tail(1)])
            yield pa.RecordBatch.from_pandas(kept, batch.schema, preserve_index=False)


class FirstPerKey(StatefulProcessor):
    """Gives out a key's first row, and the next one only when ``keep`` of event time has passed since.

    Takes and gives rows (``transformWithState``): a key has few of them, and a data frame
    for each key costs many times what its rows do.
    """

    def __init__(self, keep: dt.timedelta):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.ts is None, r.ts and _utc(r.ts), r.request_id))
        given = Row(cache_key=key[0], request_id=first.request_id, ts=first.ts, confidence=first.confidence)
        if first.ts is None:  # no time, so nothing to remember it by
            yield given
            return
        at = _utc(first.ts)
        seen = self.seen.get()  # None when the key is new or forgotten
        if seen is not None:
            known = _utc(seen[0])
            if known >= at - self.keep:
                return
            self.handle.deleteTimer(_millis(pd.Timestamp(known + self.keep)))
        self.seen.update((at,))
        self.handle.registerTimer(_millis(pd.Timestamp(at + self.keep)))
        yield given

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class StatusChanges(StatefulProcessor):
    """Changes of a run's status in event time.

    Rows wait until the watermark has passed them, so those that arrive out of
    order within its delay are put in order; what is older than the run's last
    row given out is late and dropped. A run holds the rows that still wait and
    its last row, which it forgets ``idle`` after it.
    """

    def __init__(self, idle: dt.timedelta):
        self.idle = pd.Timedelta(idle)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, status string")
        self.last = handle.getValueState("last", "ts timestamp, event_id long, status string")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer per run: the earliest of what it waits for."""
        if self.timer.exists():
            if self.timer.get()[0] <= at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        new = [(r.ts, int(r.event_id), r.status) for part in rows for r in part.itertuples(index=False)
               if r.event_id != MARK]
        if last is not None:
            new = [r for r in new if (r[0], r[1]) > (pd.Timestamp(last[0]), last[1])]
        if new:
            self.waiting.appendList([(ts.to_pydatetime(), i, s) for ts, i, s in new])
            self._wake(_millis(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((pd.Timestamp(ts), i, s) for ts, i, s in self.waiting.get())
        ready = [r for r in rows if _millis(r[0]) <= now]
        self.timer.clear()
        last = tuple(self.last.get()) if self.last.exists() else None
        changes = []
        for ts, event_id, status in ready:
            previous = last[2] if last else None
            if last is None or status != previous:
                changes.append((event_id, key[0], status, previous))
            last = (ts.to_pydatetime(), event_id, status)
        if ready:
            self.last.update(last)
            self.waiting.clear()
            if len(ready) < len(rows):
                self.waiting.put([(ts.to_pydatetime(), i, s) for ts, i, s in rows[len(ready):]])
        if len(ready) < len(rows):
            self._wake(_millis(rows[len(ready)][0]))
        elif last is not None:
            end = _millis(pd.Timestamp(last[0]) + self.idle)
            if end <= now:
                self.last.clear()
            else:
                self._wake(end)
        if changes:
            yield pd.DataFrame(changes, columns=["event_id", "run_id", "status", "prev_status"])

    def close(self) -> None:
        pass
