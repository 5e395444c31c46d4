"""The pipeline's state machine as a table, and logs checked against it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which event leads from which state to which.
TRANSITIONS = (
    ("Idle", "StartParsing", "Parsing"),
    ("Parsing", "ParseComplete", "Scaffolding"),
    ("Scaffolding", "ScaffoldComplete", "Translating"),
    ("Translating", "ChunkAccepted", "Translating"),
    ("Translating", "ChunkRetry", "Translating"),
    ("Translating", "TranslationComplete", "Verifying"),
    ("Verifying", "VerifyPassed", "Optimizing"),
    ("Verifying", "VerifyRetry", "Translating"),
    ("Optimizing", "OptimizationComplete", "Completed"),
)


def table(spark: SparkSession) -> DataFrame:
    """state, event, next: 9 rows."""
    return spark.createDataFrame(list(TRANSITIONS), "state string, event string, next string")


def illegal_pairs(log: DataFrame) -> DataFrame:
    """Rows of a log (run_id, seq, state, event) whose event isn't allowed in their state.

    Fail is allowed everywhere but in Failed, which allows Reset alone.
    """
    legal = F.broadcast(table(log.sparkSession).select("state", "event"))
    always = ((F.col("event") == "Fail") & (F.col("state") != "Failed")) | ((F.col("event") == "Reset") & (F.col("state") == "Failed"))
    return log.filter(~always).join(legal, ["state", "event"], "left_anti")


def replay(log: DataFrame, ceiling: int = 3) -> DataFrame:
    """Each run's events (run_id, seq, event) played from Idle: run_id, state, accepted, rejected.

    A chunk may be retried `ceiling` times; an accepted chunk starts over. Rejected events change nothing.
    """
    steps = {(a, e): b for a, e, b in TRANSITIONS}

    def play(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        state, tries, good, bad = "Idle", 0, 0, 0
        for event in rows.column("event").to_pylist():
            if state == "Failed":
                after = "Idle" if event == "Reset" else None
            elif event == "Fail":
                after = "Failed"
            else:
                after = steps.get((state, event))
                if event == "ChunkRetry" and after and tries >= ceiling:
                    after = None
            if after is None:
                bad += 1
                continue
            tries = tries + 1 if event == "ChunkRetry" else 0
            state, good = after, good + 1
        return pa.table({"run_id": rows.column("run_id").slice(0, 1), "state": [state], "accepted": pa.array([good], pa.int64()), "rejected": pa.array([bad], pa.int64())})

    return log.select("run_id", "seq", "event").groupBy("run_id").applyInArrow(play, "run_id bigint, state string, accepted bigint, rejected bigint")


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], cost: Callable[[DataFrame], int], most: int = 24) -> Iterator[tuple[int, DataFrame, int]]:
    """Repeat a step while it lowers the cost: yields round, table, cost; a step that doesn't is undone."""
    table_, best = start, cost(start)
    yield 0, table_, best
    for n in range(1, most + 1):
        tried = step(table_)
        now = cost(tried)
        if now >= best:
            return
        table_, best = tried, now
        yield n, table_, best
