"""Greedy choice of suggestions whose ranges overlap none that was chosen before, in rounds.

A suggestion's ranges are taken all or none. In each round every open suggestion that comes before all open
ones that it conflicts with is taken, and what conflicts with those is left out; that gives what going
one by one in order gives. Who comes first among all that overlap a range is found without pairs of ranges: a
range is a few nodes of a binary tree over positions, and two ranges overlap if a node of one lies on the
way from the other's nodes to the root. So each round takes minima by node, which combine before they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.durable import dropped, stored

#: Ranges that are left to one task, which takes them in order.
FEW = 2000


def overlaps(start: int, end: int, new_start: int, new_end: int) -> bool:
    """Whether a new range overlaps one that was taken; an insertion does inside of a range, or at its start if it comes later."""
    if new_start == new_end:
        return start <= new_start < end
    return new_start < end and start < new_end


def nodes(low: np.ndarray, high: np.ndarray, levels: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of ranges low..high, both ends included, level by level: level, rows, places, and whether a node is all within its range.

    Those within are as few as cover the range; the others hold an end of it.
    """
    rows = np.arange(len(low))
    left, right, open_ = low.copy(), high + 1, np.ones(len(low), bool)
    for level in range(levels + 1):
        takes_left = open_ & (left < right) & (left & 1 == 1)
        yield level, rows[takes_left], left[takes_left], np.ones(int(takes_left.sum()), bool)
        left = left + takes_left
        takes_right = open_ & (left < right) & (right & 1 == 1)
        right = right - takes_right
        yield level, rows[takes_right], right[takes_right], np.ones(int(takes_right.sum()), bool)
        for end in (low, high):
            yield level, rows, end >> level, np.zeros(len(low), bool)
        left, right = left >> 1, right >> 1
        open_ &= left < right


def _node_rows(edits: DataFrame, levels: int) -> DataFrame:
    """Rows (suggestion, key, within, asks, gives): nodes by which a range is found, and by which it looks for others.

    Positions are doubled, so that an insertion lies between two characters. A replaced range is found by those
    later insertions that are at its start, but doesn't find earlier ones there.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, end = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            point = start == end
            low, high = 2 * start + ~point, np.maximum(2 * end - 1, 2 * start)
            for group, own, lows, asks, gives in ((1, np.ones(len(start), bool), low, ~point, np.ones(len(start), bool)), (0, np.ones(len(start), bool), 2 * start, point, ~point)):
                for level, rows, places, within in nodes(lows[own], high[own], levels):
                    which = pa.array(rows)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(np.full(n, group * 64 + level)), pa.array(places), pa.array(within), pa.array(asks[rows]), pa.array(gives[rows])], ["suggestion", "file", "level", "place", "within", "asks", "gives"])

    schema = "suggestion bigint, file string, level bigint, place bigint, within boolean, asks boolean, gives boolean"
    found = edits.select("suggestion", "file", "start", "end").mapInArrow(split, schema)
    return found.select("suggestion", F.xxhash64("file", "level", "place").alias("key"), "within", "asks", "gives").filter("asks or gives").distinct()


def _earliest(asking: DataFrame, giving: DataFrame) -> DataFrame:
    """Per suggestion of `asking` that overlaps one of `giving`: suggestion, first, the smallest such."""
    by_node = giving.filter("gives").groupBy("key").agg(F.min("suggestion").alias("_any"), F.min(F.when(F.col("within"), F.col("suggestion"))).alias("_within"))
    found = asking.filter("asks").join(by_node, "key").select("suggestion", F.when(F.col("within"), F.col("_any")).otherwise(F.col("_within")).alias("first"))
    return found.filter("first is not null").groupBy("suggestion").agg(F.min("first").alias("first"))


def disjoint_suggestions(edits: DataFrame, few: int = FEW) -> DataFrame:
    """Of edits (suggestion, file, start, end), those of the suggestions that are taken, in the order of `suggestion`, a number.

    A suggestion is taken if no edit of it overlaps one of a suggestion taken before; its own may overlap one
    another. An insertion overlaps a range that it lies in, also at its start if the range came first; two
    insertions don't overlap. Edits without a file, place or suggestion, or that end before they start or
    start below zero, are left out first. Repeated edits come out repeated. An empty table gives no rows.
    """
    usable = edits.filter("suggestion is not null and file is not null and start >= 0 and `end` >= start").withColumn("suggestion", F.col("suggestion").cast("bigint"))
    usable = stored(usable, "edits")
    most = usable.agg(F.max("end")).first()[0]
    if most is None:
        return usable
    rows = stored(_node_rows(usable, max(1, (2 * most + 1).bit_length())), "edit-nodes")
    open_ = stored(usable.groupBy("suggestion").agg(F.count("*").alias("_n")), "open")
    taken: list[DataFrame] = []
    while (left := open_.agg(F.sum("_n")).first()[0] or 0) > few:
        own = rows.join(open_.select("suggestion"), "suggestion", "left_semi")
        first = _earliest(own, own)
        new = stored(open_.join(first, "suggestion", "left").filter("first is null or first >= suggestion").select("suggestion"), "taken")
        taken.append(new)
        rest = open_.join(new, "suggestion", "left_anti")
        gone = _earliest(own.join(new, "suggestion", "left_anti"), rows.join(new, "suggestion", "left_semi")).filter("first < suggestion")
        still = stored(rest.join(gone, "suggestion", "left_anti"), "open")
        dropped(open_)
        open_ = still
    if left:
        taken.append(_in_order(usable.join(open_, "suggestion", "left_semi")))
    out = usable.limit(0)
    if taken:
        every = taken[0]
        for t in taken[1:]:
            every = every.unionByName(t)
        out = usable.join(every, "suggestion", "left_semi")
    out = stored(out, "taken-edits")
    dropped(rows, open_, *taken, usable)
    return out


def _in_order(edits: DataFrame) -> DataFrame:
    """The suggestions that are taken of a few, one by one."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple]] = {}
        for batch in batches:
            for s, *edit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own.setdefault(s, []).append(tuple(edit))
        used: dict[str, list[tuple]] = {}
        taken = []
        for s in sorted(own):
            if not any(overlaps(a, b, start, end) for file, start, end in own[s] for a, b in used.get(file, ())):
                taken.append(s)
                for file, start, end in own[s]:
                    used.setdefault(file, []).append((start, end))
        yield pa.RecordBatch.from_pydict({"suggestion": pa.array(taken, pa.int64())})

    return edits.select("suggestion", "file", F.col("start").cast("bigint"), F.col("end").cast("bigint")).coalesce(1).mapInArrow(choose, "suggestion bigint")
