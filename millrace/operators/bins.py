"""Greedy bins of ordered rows, without going from row to row.

A bin that begins at a row ends where the sum of sizes since passes the budget: a search in the running
sums. So each row knows where the next bin would begin, and doubling these ways finds the rows where
bins do begin. A part of the rows doesn't know how full the bin is that comes in; what goes out depends on
that only by the first row that no longer fits, so a part is summed up by one entry for each such row.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators import scan


def segments(keys: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, the rows where a key begins, and for each row where its key ends."""
    codes = keys.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    last = np.append(first[1:], len(codes))
    return first, np.repeat(last, last - first)


def ends(part: pa.Table) -> list[str]:
    """The first and the last key of a part, as text."""
    return [repr(part.column(0)[i].as_py()) for i in (0, len(part) - 1)]


def _starts(sizes: np.ndarray, first: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums before each row, where a bin that begins at a row would end, and where each key ends.

    `first`: rows where a key begins. All are places of rows; a bin ends before the row that is given.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    stops = np.append(first[1:], len(sizes))
    end_of = np.repeat(stops, stops - first)
    at = np.searchsorted(before[1:], before[:-1] + budget, side="right")
    return before, np.minimum(np.maximum(at, np.arange(len(sizes)) + 1), end_of), end_of


def reached(begin: np.ndarray, to: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """Whether a way from the given rows comes by each row; each round doubles how far ways are followed."""
    n = len(to)
    jump = np.append(np.where(to < end_of, to, n), n)
    hit = np.zeros(n + 1, bool)
    hit[begin] = True
    while True:
        new = jump[np.flatnonzero(hit[:n])]
        new = new[~hit[new] & (new < n)]
        if not len(new):
            return hit[:n]
        hit[new] = True
        jump = jump[jump]


def last_on_way(to: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the last row that a bin begins at on the way from it, and how many bins there are after its own."""
    goes = to < end_of
    last, count = np.where(goes, to, np.arange(len(to))), goes.astype(np.int64)
    while not np.array_equal(further := last[last], last):
        count, last = count + count[last], further
    return last, count


def bin_machine(budget: int) -> scan.Machine:
    """Bins of rows (key, order, size), sorted, over any parts."""

    def read(part: pa.Table):
        return part.column(2).to_numpy(), segments(part.column(0))[0]

    def summary(part: pa.Table) -> bytes:
        sizes, first = read(part)
        before, to, end_of = _starts(sizes, first, budget)
        last, count = last_on_way(to, end_of)
        n = end_of[0]
        # what goes out of the first key's rows if row j is the first that the bin that comes in doesn't take
        sums = before[1 : n + 1]
        breaks = np.flatnonzero(np.concatenate([[True], (sums[1:] > sums[:-1]) & (sums[:-1] <= budget)]))
        out = np.stack([sums[breaks], before[n] - before[last[breaks]], count[breaks] + 1])
        at = first[-1]
        fresh = int(before[-1] - before[last[at]]), int(count[at])
        return pickle.dumps((*ends(part), n == len(sizes), int(before[n]), out, fresh))

    def carry(state: bytes | None, told: bytes) -> bytes:
        """The key that a part ends with, how full its open bin is, and that bin's number."""
        name, last, single, total, out, fresh = pickle.loads(told)
        if state is None or (was := pickle.loads(state))[0] != name or not single:
            return pickle.dumps((last, *fresh))
        _, used, bin_ = was
        j = int(np.searchsorted(out[0], budget - used, side="right")) if used <= budget else 0
        if j == out.shape[1]:
            return pickle.dumps((last, used + total, bin_))
        return pickle.dumps((last, int(out[1, j]), bin_ + int(out[2, j])))

    def apply(part: pa.Table, state: bytes | None) -> pa.Table:
        sizes, first = read(part)
        before, to, end_of = _starts(sizes, first, budget)
        begin, n, open_ = first, end_of[0], None
        if state is not None and (was := pickle.loads(state))[0] == ends(part)[0]:
            _, used, open_ = was
            j = int(np.searchsorted(before[1 : n + 1], budget - used, side="right")) if used <= budget else 0
            begin = np.append(first[1:], j) if j < n else first[1:]
        hit = reached(begin, to, end_of)
        bins = np.cumsum(hit)
        number = bins - np.repeat(bins[first] - hit[first], np.diff(np.append(first, len(sizes)))) - 1
        if open_ is not None:
            number[:n] = open_ + bins[:n]
        return part.select([0, 1, 2]).append_column("bin", pa.array(number, pa.int64()))

    return scan.Machine(summary, carry, apply)


def greedy_bins(sized: DataFrame, key: str, budget: int, order: str = "pos", tokens: str = "tokens") -> DataFrame:
    """Rows (key, pos, tokens) with the bin they go to: a new bin when the open one, not empty, would overflow.

    A row above the budget is a bin of its own. Null sizes count nothing; null keys are a key; an empty
    table gives no rows. Rows of one key may be any number: they are sorted and cut into parts.
    """
    read = sized.select(F.col(key), F.col(order).cast("bigint").alias(order), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias(tokens))
    rows = scan.placed(read, [key], [order])
    return scan.two_pass(rows, bin_machine(budget), StructType([*rows.schema.fields[:3], StructField("bin", LongType())]))


def with_preamble(bins: DataFrame, preambles: DataFrame, key: str, budget: int) -> DataFrame:
    """Bins (key, bin, tokens) with a text's preamble (key, tokens) in the first if it fits, else before it; renumbered.

    Only a key's first bin decides, so no key's bins are gathered.
    """
    pre = bins.filter("bin = 0").select(F.col(key).alias("_key"), F.col("tokens").alias("_first")).join(preambles.select(F.col(key).alias("_of"), F.col("tokens").alias("_pre")), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
    pre = pre.withColumn("_fits", F.col("_pre") + F.col("_first") <= budget)
    own = bins.join(pre, F.col(key).eqNullSafe(F.col("_key")), "left")
    moved = F.coalesce((~F.col("_fits")).cast("bigint"), F.lit(0))
    more = F.when((F.col("bin") == 0) & F.col("_fits"), F.col("_pre")).otherwise(0)
    own = own.select(key, (F.col("bin") + moved).alias("bin"), (F.col("tokens") + more).alias("tokens"))
    return own.unionByName(pre.filter("not _fits").select(F.col("_key").alias(key), F.lit(0).cast("bigint").alias("bin"), F.col("_pre").alias("tokens")))
