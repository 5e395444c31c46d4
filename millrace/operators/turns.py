"""Runs that are let in one at a time for each key, and lines that go on from read to read: two-pass machines.

Both take a key's rows in order. What a part of the sorted rows does with what comes in is summed up by a
few numbers or a piece of a line, so parts are read side by side.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from millrace.operators import scan
from millrace.operators.bins import ends, last_on_way, reached, segments


def admit_machine() -> scan.Machine:
    """Whether rows (key, begin, order, end), sorted, are let in: those that begin when none let in before goes on."""

    def read(part: pa.Table):
        first, end_of = segments(part.column(0))
        begin, end = part.column(1).to_numpy(), part.column(3).to_numpy()
        # the next row of a key that begins at an end or later: keys are set apart, so one search serves all
        values = np.unique(np.concatenate([begin, end]))
        line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin)))) * (len(values) + 1)
        to = np.searchsorted(line + np.searchsorted(values, begin), line + np.searchsorted(values, end), side="left")
        return first, end_of, begin, end, np.minimum(np.maximum(to, np.arange(len(begin)) + 1), end_of)

    def summary(part: pa.Table) -> bytes:
        first, end_of, begin, end, to = read(part)
        last, _ = last_on_way(to, end_of)
        n = end_of[0]
        # from when on a run of the first key is let in, and until when the last one goes on then; equal ones as one
        at, out = np.unique(begin[:n], return_index=True)
        after = end[last[out]]
        change = np.append(after[1:] != after[:-1], True)
        return pickle.dumps((*ends(part), n == len(begin), at[change], after[change], int(end[last[first[-1]]])))

    def carry(state: bytes | None, told: bytes) -> bytes:
        name, last, single, at, after, fresh = pickle.loads(told)
        if state is None or (was := pickle.loads(state))[0] != name or not single:
            return pickle.dumps((last, fresh))
        k = int(np.searchsorted(at, was[1], side="left"))
        return pickle.dumps((last, was[1] if k == len(at) else int(after[k])))

    def apply(part: pa.Table, state: bytes | None) -> pa.Table:
        first, end_of, begin, _, to = read(part)
        starts = first
        if state is not None and (was := pickle.loads(state))[0] == ends(part)[0]:
            k = int(np.searchsorted(begin[: end_of[0]], was[1], side="left"))
            starts = np.append(first[1:], k) if k < end_of[0] else first[1:]
        return pa.table([part.column(0), part.column(2), pa.array(reached(starts, to, end_of))], names=[part.column_names[0], part.column_names[2], "admitted"])

    return scan.Machine(summary, carry, apply)


def admitted(requests: DataFrame, key: str, begin: str, end: str, order: str) -> DataFrame:
    """Requests (key, order) with whether they are let in: one run of a key at a time, others are turned away.

    A request that begins when the run before ends is let in. Requests without a begin or end are left out;
    null keys are a key. Any number may be of one key.
    """
    long = lambda c: F.col(c).cast("bigint").alias(c)
    known = requests.select(key, F.col(begin).cast("bigint").alias("_begin"), long(order), F.col(end).cast("bigint").alias("_end")).filter("_begin is not null and _end is not null")
    rows = scan.placed(known, [key], ["_begin", order])
    return scan.two_pass(rows, admit_machine(), StructType([rows.schema[0], rows.schema[2], StructField("admitted", BooleanType())]))


def _event(line: str) -> str | None:
    data = line.strip()
    return (data.removeprefix("data:").strip() or None) if data.startswith("data:") else None


def line_machine() -> scan.Machine:
    """Events of reads (key, order, text), sorted, whose lines may go on in the next read."""

    def keys(part: pa.Table) -> list[tuple[int, str]]:
        first, _ = segments(part.column(0))
        text = part.column(2).to_pylist()
        return [(int(a), "".join(text[a:b])) for a, b in zip(first, [*first[1:], len(text)], strict=True)]

    def after(text: str) -> tuple[int, str]:
        """Events in whole lines, and the line that isn't whole."""
        *lines, tail = text.split("\n")
        return sum(_event(x) is not None for x in lines), tail

    def summary(part: pa.Table) -> bytes:
        found = keys(part)
        head, *rest = found[0][1].split("\n", 1)
        # a first key's text may begin within a line: its first line's rest, and what follows it, if it ends
        told = (head, after(rest[0]) if rest else None)
        return pickle.dumps((*ends(part), len(found) == 1, told, after(found[-1][1])))

    def carry(state: bytes | None, told: bytes) -> bytes:
        name, last, single, (head, rest), fresh = pickle.loads(told)
        if state is None or (was := pickle.loads(state))[0] != name or not single:
            return pickle.dumps((last, *fresh))
        _, n, tail = was
        if rest is None:
            return pickle.dumps((last, n, tail + head))
        return pickle.dumps((last, n + (_event(tail + head) is not None) + rest[0], rest[1]))

    def apply(part: pa.Table, state: bytes | None) -> pa.Table:
        at, n, found = [], [], []
        for i, (a, text) in enumerate(keys(part)):
            count = 0
            if i == 0 and state is not None and (was := pickle.loads(state))[0] == ends(part)[0]:
                _, count, tail = was
                text = tail + text
            for line in text.split("\n")[:-1]:
                if (data := _event(line)) is not None:
                    at.append(a)
                    n.append(count)
                    found.append(data)
                    count += 1
        return pa.table([part.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(found, pa.string())], names=[part.column_names[0], "n", "json"])

    return scan.Machine(summary, carry, apply)


def events_of_reads(reads: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Events (key, n, json) of server-sent streams that arrived in reads of any size, in order.

    A line may be cut by a read anywhere and counts once its end has arrived; of those, `data:` lines
    with something in them are events. A null read is an empty one. A stream may have any number of reads.
    """
    rows = scan.placed(reads.select(key, F.col(order).alias("_order"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")), [key], ["_order"])
    return scan.two_pass(rows, line_machine(), StructType([rows.schema[0], StructField("n", LongType()), StructField("json", StringType())]))
