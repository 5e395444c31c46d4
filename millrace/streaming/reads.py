"""Server-sent event streams as a streaming source, and their lines put together across batches.

A stream is a file that grows. The source reads what has been added since the offsets of the last batch, in
reads of a fixed number of bytes, so lines and even characters may be cut anywhere. What a read leaves of
a line waits in state for the rest of it, so events do not depend on how reads and batches fall, and a
restart goes on from the checkpoint's offsets and state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.sources.walk import system_of

#: Bytes of a read, and of the reads that one task makes of several streams, about.
READ, TASK = 1 << 16, 32 << 20


class Range(InputPartition):
    """Byte ranges (stream, from, to) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class EventReads(DataSource):
    """Format `event_reads`: rows (stream, at, read) of all files below `path`; `bytes` is the size of a read.

    Offsets hold each stream's length. Hidden files and those of writers in progress are no streams.
    """

    @classmethod
    def name(cls) -> str:
        return "event_reads"

    def schema(self) -> str:
        return "stream string, at bigint, read binary"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return EventReader(self.options["path"], int(self.options.get("bytes", READ)))


class EventReader(DataSourceStreamReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, max(1, size)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        system, root = system_of(self.root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.File and not any(p[:1] in "._" for p in name.split("/")):
                found[name] = info.size
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        tasks, held, own = [], 0, []
        for stream in sorted(end):
            at = start.get(stream, 0)
            while at < end[stream]:
                to = min(end[stream], at + TASK - held)
                own.append((stream, at, to))
                held, at = held + to - at, to
                if held >= TASK:
                    tasks.append(Range(own))
                    held, own = 0, []
        return [*tasks, Range(own)] if own else tasks

    def read(self, partition: Range) -> Iterator[tuple]:
        system, root = system_of(self.root)
        for stream, start, end in partition.ranges:
            with system.open_input_file(f"{root.rstrip('/')}/{stream}") as f:
                for at in range(start, end, self.size):
                    yield stream, at, f.read_at(min(self.size, end - at), at)

    def commit(self, end: dict) -> None:
        pass


class LineJoin(StatefulProcessor):
    """Per stream: how far it was read, how many events it had, and what there is of its last line."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", "at bigint, n bigint, tail binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, n, tail = self.state.get() if self.state.exists() else (0, 0, b"")
        reads = pd.concat(list(rows)).sort_values("at")
        new = []
        for place, read in zip(reads["at"], reads["read"], strict=True):
            if place < at:  # read before
                continue
            at = int(place) + len(read)
            new.append(bytes(read))
        *lines, tail = (bytes(tail) + b"".join(new)).split(b"\n")
        out = []
        for line in lines:
            data = line.decode(errors="replace").strip()
            if data.startswith("data:") and (data := data.removeprefix("data:").strip()):
                out.append((key[0], n, data))
                n += 1
        self.state.update((at, n, tail))
        yield pd.DataFrame(out, columns=["stream", "n", "json"]).astype({"n": "int64"})

    def close(self) -> None:
        pass


def event_lines(spark: SparkSession, root: str, size: int = READ) -> DataFrame:
    """A stream of events (stream, n, json) of the event streams below a folder: what follows `data:` in each whole line.

    A line without its end waits; empty events are none; bytes that are no characters become U+FFFD.
    """
    spark.dataSource.register(EventReads)
    reads = spark.readStream.format("event_reads").option("path", root).option("bytes", size).load()
    return reads.groupBy("stream").transformWithStateInPandas(LineJoin(), "stream string, n bigint, json string", "Append", "None")


def read_once(spark: SparkSession, root: str, out: str, checkpoint: str, size: int = READ) -> None:
    """All events that have come, added to a folder of Parquet once each; a later call goes on where this one ended."""
    from millrace.streaming.watch import with_rocks

    with with_rocks(spark):
        event_lines(spark, root, size).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
