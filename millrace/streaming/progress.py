"""Progress of runs from their events, the same fold in batch and in Structured Streaming.

Events are (run_id, seq, kind, stage, ts); `seq` orders a run's events, so a fold by the highest seq
doesn't depend on arrival. `done` and `failed` end a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import scan
from millrace.operators.classify import stage_percent
from millrace.operators.turns import admitted, events_of_reads  # noqa: F401  (parts of what follows runs)

EVENT = "run_id bigint, seq bigint, kind string, stage string, ts timestamp"
TERMINAL = ("done", "failed")


def parsed(lines: DataFrame) -> DataFrame:
    """Events of JSON lines; lines that aren't events are ignored."""
    return lines.select(F.from_json("value", EVENT).alias("e")).filter("e.run_id is not null and e.seq is not null and e.kind is not null").select("e.*")


def folded(events: DataFrame) -> DataFrame:
    """Per run: stage, percent, files done, errors, whether it ended and how, events, first and last time.

    Works on batch and streaming frames alike (streams in update or complete mode); all aggregates
    combine before the shuffle.
    """
    last = F.max_by("stage", "seq")
    ended = F.max_by(F.when(F.col("kind").isin(*TERMINAL), F.col("kind")), F.when(F.col("kind").isin(*TERMINAL), F.col("seq")))
    return events.groupBy("run_id").agg(
        last.alias("stage"),
        F.count_if(F.col("kind") == "file_complete").alias("files"),
        F.count_if(F.col("kind") == "compiler_error").alias("errors"),
        ended.alias("ended"),
        F.count("*").alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).withColumn("percent", F.when(F.col("ended") == "done", 100).otherwise(stage_percent(F.col("stage"))))


def eta(progress: DataFrame, total: int) -> DataFrame:
    """Runs with a rate in files a second, a percentage from 10 to 70, and seconds to go (null without a rate)."""
    elapsed = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    rate = F.when((elapsed > 0) & (F.col("files") > 0), F.col("files") / elapsed)
    return progress.select("run_id", "files", rate.alias("rate"), F.least(F.lit(70.0), 10 + F.col("files") / total * 60).alias("percent"), (F.greatest(F.lit(0), total - F.col("files")) / rate).alias("seconds_left"))


def error_preview(texts: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """The first lines that hold `error[` or `error:`, joined."""
    hits = F.slice(F.filter(F.split(text, "\n"), lambda x: x.contains("error[") | x.contains("error:")), 1, most)
    return texts.select(key, F.array_join(hits, "\n").alias("preview"))


def unfinished(progress: DataFrame) -> DataFrame:
    """Runs without a terminal event, as failed ones: what a stream that broke off stands for."""
    return progress.filter("ended is null").select("run_id", F.lit("failed").alias("kind"), F.col("events").alias("seq"))


def idle(progress: DataFrame, now: str, seconds: int) -> DataFrame:
    """Runs that haven't ended and were silent for so long."""
    return progress.filter(F.col("ended").isNull() & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_ts") > seconds)).select("run_id")


def watched(events: DataFrame, seconds: int = 60) -> DataFrame:
    """A stream of events to one row for each run that ended, or `failed` if it fell silent.

    State is a run's last seq and time; it goes when the run ends or its event-time timer fires.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seq,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "kind": ["failed"], "seq": [seq]})
            return
        seq, ended = state.get[0] if state.exists else -1, None
        latest = 0
        for f in frames:
            seq, latest = max(seq, int(f["seq"].max())), max(latest, int(f["ts"].max().timestamp() * 1000))
            last = f[f["kind"].isin(TERMINAL)].nlargest(1, "seq")
            if len(last) and (ended is None or last["seq"].iloc[0] > ended[1]):
                ended = last["kind"].iloc[0], int(last["seq"].iloc[0])
        if ended is not None:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "kind": [ended[0]], "seq": [ended[1]]})
            return
        state.update((seq,))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + seconds * 1000)

    return events.withWatermark("ts", "0 seconds").groupBy("run_id").applyInPandasWithState(watch, "run_id bigint, kind string, seq bigint", "seq bigint", "append", GroupStateTimeout.EventTimeTimeout)


def gated(requests: DataFrame, time: str, order: str, gap: int, keys: list[str] | None = None) -> DataFrame:
    """Requests with `fires`, when a gate lets them through that keeps calls `gap` apart.

    One gate is for all workers, or one for each value of `keys`. A request fires on arrival or `gap` after
    the one before, whichever is later; so the n-th fires at the latest of what earlier arrivals and the gaps
    since them come to: a running maximum, by a prefix scan whose parts are side by side in time.
    """
    keys = keys or []
    rows = scan.placed(requests, keys, [time, order])
    counted = scan.running(rows, keys, _n=("sum", F.lit(gap).cast("bigint")))
    spaced = scan.running(counted, keys, _late=("max", F.col(time) - F.col("_n")))
    return spaced.withColumn("fires", F.col("_n") + F.col("_late")).drop("_n", "_late", scan.PART, scan.AT)


def stream_files(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Events from files of JSON lines as they arrive, so many files at a time."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder))


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Process all that has arrived and stop; one query for each checkpoint, so a run is active once."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
