"""Ends, silence and death of runs in a stream of their events, with state and timers of its own.

A run is open from its first event. `done` or `failed` ends it. A run that falls silent is reported idle, and
if it stays silent its worker is taken for dead and a `failed` is made up. What comes for an ended run soon
after its end is ignored, such as a repeated end; then its state goes, and a later event opens it anew.

All times are event times, so it does not matter how events are split over batches: a silence is seen by a
timer when other runs go on, or else by the run's own next event.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.progress import TERMINAL

#: A report: what became of a run, the last event's number, when, and whether no event said so.
REPORT = "run_id bigint, kind string, seq bigint, at timestamp, made_up boolean"
STATE = "seq bigint, last bigint, closed boolean, idle boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunWatch(StatefulProcessor):
    """Per run: its last event's number and time, whether it ended, and whether its silence was reported."""

    def __init__(self, idle_ms: int, dead_ms: int):
        self.idle_ms, self.dead_ms = idle_ms, dead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def _timers(self, last: int, closed: bool, on: bool) -> None:
        set_ = self.handle.registerTimer if on else self.handle.deleteTimer
        for after in (self.dead_ms,) if closed else (self.idle_ms, self.dead_ms):
            set_(last + after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (run_id,) = key
        seq, last, closed, idle = self.run.get() if self.run.exists() else (None, None, False, False)
        before = None if last is None else (last, closed)
        out: list[tuple] = []
        batch = pd.concat(list(rows))
        for ts, n, kind in sorted(zip(batch["ms"], batch["seq"], batch["kind"], strict=True)):
            if last is not None and not closed:
                ts = max(ts, last)
                if ts - last > self.idle_ms and not idle:
                    out.append((run_id, "idle", seq, last + self.idle_ms, True))
                if ts - last > self.dead_ms:
                    out.append((run_id, "failed", seq, last + self.dead_ms, True))
                    last, closed = last + self.dead_ms, True
            if closed:
                if ts - last <= self.dead_ms:
                    continue
                closed = False
            seq, last, idle = int(n), int(ts), False
            if kind in TERMINAL:
                out.append((run_id, kind, seq, last, False))
                closed = True
        if before:
            self._timers(*before, False)
        if last is not None:
            self.run.update((seq, last, closed, idle))
            self._timers(last, closed, True)
        yield _reports(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (run_id,) = key
        out: list[tuple] = []
        if self.run.exists():
            seq, last, closed, idle = self.run.get()
            due = expiredTimerInfo.getExpiryTimeInMs() - last
            if closed and due >= self.dead_ms:
                self.run.clear()
            elif not closed and due >= self.dead_ms:
                if not idle:
                    out.append((run_id, "idle", seq, last + self.idle_ms, True))
                out.append((run_id, "failed", seq, last + self.dead_ms, True))
                self.run.update((seq, last + self.dead_ms, True, False))
                self._timers(last + self.dead_ms, True, True)
            elif not closed and due >= self.idle_ms and not idle:
                out.append((run_id, "idle", seq, last + self.idle_ms, True))
                self.run.update((seq, last, False, True))
        yield _reports(out)

    def close(self) -> None:
        pass


def _reports(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["run_id", "kind", "seq", "ms", "made_up"])
    return df.astype({"run_id": "int64", "seq": "int64", "ms": "int64", "made_up": "bool"})


def watched(events: DataFrame, idle: int, dead: int, late: str = "0 seconds") -> DataFrame:
    """A stream of events (run_id, seq, kind, ts) to reports of ends, of silence over `idle` seconds, and of death after `dead`.

    Events without a run, number, kind or time are ignored; those that come out of order count at the time of
    the last before them, and those later than `late` behind all others are dropped. Of equal times the
    lower number comes first.
    """
    known = events.filter("run_id is not null and seq is not null and kind is not null and ts is not null")
    timed = known.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    found = timed.groupBy("run_id").transformWithStateInPandas(RunWatch(idle * 1000, dead * 1000), "run_id bigint, kind string, seq bigint, ms bigint, made_up boolean", "Append", "EventTime")
    return found.select("run_id", "kind", "seq", F.timestamp_millis("ms").alias("at"), "made_up")


def watch_files(spark: SparkSession, inbox: str, out: str, checkpoint: str, idle: int, dead: int, per_trigger: int = 1) -> None:
    """Reports of all event files that have come, added to a folder of Parquet once each; a later call goes on where this one ended."""
    from millrace.streaming.progress import stream_files

    with with_rocks(spark):
        reports = watched(stream_files(spark, inbox, per_trigger), idle, dead)
        reports.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state with timers asks for, as long as a query starts and runs; the session's own comes back after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)
