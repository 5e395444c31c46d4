"""Near duplicates of embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its components, with one correction
factor: the inner product of the signs (as a unit vector) and the rotated vector. For another vector,
given as 4-bit numbers after the same rotation, the inner product with the signs, divided by the
factor, is an unbiased estimate of the cosine. Its error has a known spread; pairs whose upper
confidence bound stays below the threshold are left out and all others are computed again from the
vectors.

Which vectors are compared at all follows from random pivots. A vector is in the cell of its best
pivot and of every other whose inner product is nearly as large, and is compared with the vectors of
its cells. Pivots don't depend on the data, so what two linked vectors differ by points in a random
direction as seen from them, and its inner product with a pivot has a known spread, too: within
`REACH` spreads of the best pivot, two linked vectors share a cell. Cells are about as many as
vectors by `CELL`, so a vector's work depends on how many cells it is in, not on the table.

Codes travel to the cells first. Only vectors that a bound leaves in doubt there, with another of
the cell, follow as themselves, and a pair is counted in the first cell that both are in. What leaves
a task is a number of links for each vector and a spanning forest of the links, so a family of any
size is never spelled out as pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, written
from millrace.llm.components import components
from millrace.llm.vptree import one_vector_each, several_vectors, signature, usable

THRESHOLD = 0.95
#: Vectors for which there is one cell, and cells at most (which bounds what a worker keeps of pivots).
CELL, CELLS = 128, 1 << 18
#: How far from the best pivot, in spreads, a vector is in other cells as well.
REACH = 2.0
#: Members of a cell that are compared as one block, and members that a task gets of all its cells, about.
BLOCK, TASK = 4096, 32768
#: Tasks at least, so that small tables use several, too.
TASKS = 8
#: Standard deviations that the confidence bound is wide.
SPREAD = 6.0
#: Bits of a component of the other vector, and the seed of rotation, rounding and pivots.
BITS, SEED = 4, 77
#: Rows of a block that are compared at a time.
ROWS = 512


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=4)
def pivots(d: int, cells: int) -> np.ndarray:
    """Random directions, the same in every task."""
    x = np.random.default_rng((SEED, d)).normal(size=(cells, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: same directions to the bit, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bytes."""
    return np.packbits(bits, axis=1, bitorder="little")


@dataclass
class Codes:
    """Binary codes of unit vectors with their correction factors, and their 4-bit numbers."""

    d: int
    signs: np.ndarray  # bytes, a row for each vector
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray
    levels: np.ndarray  # bytes, two numbers in each

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        d = unit.shape[1]
        rotated = unit @ rotation(d).T
        factor = np.abs(rotated).sum(1) / math.sqrt(d)
        # components as 4-bit numbers, rounded up or down at random without bias
        low = rotated.min(1)
        step = np.maximum(rotated.max(1) - low, 1e-12) / ((1 << BITS) - 1)
        dice = np.random.default_rng(SEED + 1).random(rotated.shape)
        level = np.clip(np.floor((rotated - low[:, None]) / step[:, None] + dice), 0, (1 << BITS) - 1).astype(np.uint8)
        level = np.pad(level, ((0, 0), (0, d % 2)))
        return cls(d, packed(rotated > 0), factor, low, step, level[:, ::2] | level[:, 1::2] << BITS)

    def take(self, rows) -> Codes:
        return Codes(self.d, self.signs[rows], self.factor[rows], self.low[rows], self.step[rows], self.levels[rows])

    def spread(self) -> np.ndarray:
        """Standard deviation of an estimate for vectors at right angles; less by the sine for nearer ones."""
        return np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(1, self.d - 1))

    def plus_minus(self) -> np.ndarray:
        """The signs as numbers."""
        return np.unpackbits(self.signs, axis=1, bitorder="little", count=self.d).astype(np.float32) * 2 - 1

    def rounded(self) -> np.ndarray:
        """The rotated vectors as their 4-bit numbers tell them."""
        both = np.stack([self.levels & 15, self.levels >> BITS], 2).reshape(len(self.levels), -1)[:, : self.d]
        return (self.low[:, None] + self.step[:, None] * both).astype(np.float32)

    def estimates(self, other: Codes, rows: slice) -> np.ndarray:
        """Estimated inner products of these vectors' rows with all of the other's."""
        own = self.take(rows)
        return own.plus_minus() @ other.rounded().T / (math.sqrt(self.d) * own.factor[:, None]).astype(np.float32)


def doubtful(a: Codes, b: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (rows of a, rows of b) of pairs whose upper confidence bound reaches the threshold.

    With `same`, each pair of the one set comes once. The error has two independent parts: that of
    the signs, and that of rounding to 4 bits, which is half a step for each component at most.
    """
    if not len(a.signs) or not len(b.signs):
        return
    sine = math.sqrt(max(0.0, 1 - threshold * threshold))
    rounding = float(b.step.max()) / 2 / a.factor
    least = threshold - SPREAD * np.sqrt((sine * a.spread()) ** 2 + rounding**2)
    bound = (least * math.sqrt(a.d) * a.factor).astype(np.float32) - np.float32(1e-4)
    signs, numbers = a.plus_minus(), b.rounded().T
    for start in range(0, len(signs), ROWS):
        first = start if same else 0
        i, j = np.nonzero(signs[start : start + ROWS] @ numbers[:, first:] >= bound[start : start + ROWS, None])
        i, j = i + start, j + first
        if same:
            i, j = i[j > i], j[j > i]
        yield i, j


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have a cosine from the threshold on, in double precision."""
    out = np.zeros(len(i), bool)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[s : s + (1 << 16)] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
    return out


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each of n rows is connected with."""
    label = np.arange(n)
    for p, q in pairs:
        while True:
            lo, hi = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
            open_ = lo < hi
            if not open_.any():
                break
            np.minimum.at(label, hi[open_], lo[open_])
            while (label[label] != label).any():
                label = label[label]
    return label


def reach(d: int, threshold: float) -> float:
    """How much less than with its best pivot a vector's inner product is with others whose cells it is in.

    Twice the distance of linked vectors is always enough; with many components, far less is.
    """
    sine = math.sqrt(max(0.0, 1 - threshold * threshold))
    return min(2 * math.sqrt(max(0.0, 2 - 2 * threshold)), REACH * sine * math.sqrt(2 / max(1, d - 1))) + 1e-6


def cells_of(unit: np.ndarray, cells: int, threshold: float) -> list[np.ndarray]:
    """The cells that each vector is in, ascending."""
    p, out, margin = pivots(unit.shape[1], cells), [], reach(unit.shape[1], threshold)
    rows = max(1, (1 << 22) // cells)
    for s in range(0, len(unit), rows):
        x = unit[s : s + rows].astype(np.float32) @ p.T
        i, j = np.nonzero(x >= x.max(1, keepdims=True) - np.float32(margin))
        out += np.split(j.astype(np.int32), np.searchsorted(i, np.arange(1, len(x))))
    return out


CODE = "struct<cells: array<int>, signs: binary, factor: float, low: float, step: float, levels: binary>"


def code(embedding: Column, cells: int, threshold: float) -> Column:
    """Cells and codes of each vector, in a struct."""

    @F.arrow_udf(CODE)
    def coded(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in vectors:
            width = batch.value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.concatenate([[0], np.cumsum(width)])
            found: list = [None] * len(width)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = balanced(flat[start[at][:, None] + np.arange(w)])
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                c = Codes.of(unit)
                for k, own in zip(range(len(at)), cells_of(unit, cells, threshold), strict=True):
                    found[at[k]] = (own, c.signs[k].tobytes(), c.factor[k], c.low[k], c.step[k], c.levels[k].tobytes())
            kinds = [pa.list_(pa.int32()), pa.binary(), pa.float32(), pa.float32(), pa.float32(), pa.binary()]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["cells", "signs", "factor", "low", "step", "levels"])

    return coded(embedding)


def stored(rows: pa.Table, d: int) -> Codes:
    """The codes that a table has in columns."""
    wide = lambda k: np.frombuffer(b"".join(rows.column(k).to_pylist()), np.uint8).reshape(len(rows), -1)
    number = lambda k: rows.column(k).to_numpy().astype(np.float64)
    return Codes(d, wide("signs"), number("factor"), number("low"), number("step"), wide("levels"))


def cell_sides(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Yields what is compared of a task's table: (cell, rows, null), or (cell, rows of one block, of the other)."""
    cell = rows.column("cell").to_numpy()
    x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
    if x < 0 or x == y:
        order = np.argsort(cell, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            yield int(cell[own[0]]), own, None
    else:
        block = rows.column("block").to_numpy()
        yield int(cell[0]), np.flatnonzero(block == x), np.flatnonzero(block == y)


def in_doubt(rows: pa.Table, threshold: float) -> pa.Table:
    """Members of cells (d, cell, node) that a bound leaves in doubt with another of the cell."""
    d = rows.column("d")[0].as_py()
    codes, mark = stored(rows, d), np.zeros(len(rows), bool)
    for _, a, b in cell_sides(rows):
        one = codes.take(a)
        for i, j in doubtful(one, one if b is None else codes.take(b), threshold, b is None):
            mark[a[i]] = True
            mark[(a if b is None else b)[j]] = True
    return rows.select(["d", "cell", "node"]).filter(pa.array(mark))


def earlier(lists: np.ndarray, cell: int) -> np.ndarray:
    """Per row, which of the cells before this one it is in, as bits of bytes; lists are filled up with -1.

    A cell that only one row is in can't be shared and has no bit.
    """
    row, at = np.nonzero((lists >= 0) & (lists < cell))
    ids, at, n = np.unique(lists[row, at], return_inverse=True, return_counts=True)
    bit = np.cumsum(n > 1) - 1
    some = n[at] > 1
    row, at = row[some], bit[at[some]]
    out = np.zeros((len(lists), max(1, -(-int((n > 1).sum()) // 8))), np.uint8)
    np.bitwise_or.at(out, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return out


def compared(rows: pa.Table, threshold: float) -> pa.Table:
    """Of a task's table of vectors: (node, links, null) and (node, null, node it is connected with)."""
    d = rows.column("d")[0].as_py()
    codes, node, weight = stored(rows, d), rows.column("node").to_numpy(), rows.column("weight").to_numpy()
    x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = balanced(x) if len(x) else x
    width = rows.column("cells").combine_chunks().value_lengths().to_numpy()
    lists = np.full((len(rows), int(width.max())), -1, np.int32)
    lists[np.arange(lists.shape[1])[None] < width[:, None]] = rows.column("cells").combine_chunks().flatten().to_numpy()
    ids, at = np.unique(node, return_inverse=True)
    count, pairs = np.zeros(len(ids), np.int64), []
    for cell, a, b in cell_sides(rows):
        one, both = codes.take(a), a if b is None else np.concatenate([a, b])
        before = earlier(lists[both], cell)
        for i, j in doubtful(one, one if b is None else codes.take(b), threshold, b is None):
            j = j if b is None else j + len(a)
            new = ~(before[i] & before[j]).any(1)
            i, j = both[i[new]], both[j[new]]
            ok = exact(x, x, i, j, threshold)
            i, j = i[ok], j[ok]
            np.add.at(count, at[i], weight[j])
            np.add.at(count, at[j], weight[i])
            pairs.append((at[i], at[j]))
        if len(pairs) > 64:  # keep what is held small: a forest stands for its links
            label = forest(len(ids), pairs)
            own = np.flatnonzero(label != np.arange(len(ids)))
            pairs = [(own, label[own])]
    label = forest(len(ids), pairs)
    some, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids)))
    return pa.table(
        {
            "node": pa.array(np.concatenate([ids[some], ids[tied]])),
            "links": pa.array(np.concatenate([count[some], np.zeros(len(tied), np.int64)])),
            "end": pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[label[tied]]]), mask=np.arange(len(some) + len(tied)) < len(some)),
        }
    )


def dealt(members: DataFrame, block: int) -> DataFrame:
    """Members of cells (d, cell, node) with the task they go to: task, x, y, block.

    Cells share tasks; one of more than `block` members is cut into blocks by hash, and each pair of
    its blocks is a task of its own. Only the large cells' sizes are broadcast, CELLS rows at most.
    """
    sizes = members.groupBy("d", "cell").count()
    every = sizes.agg(F.sum("count")).first()[0] or 0
    large = sizes.filter(F.col("count") > block).select("d", "cell", F.ceil(F.col("count") / block).cast("int").alias("_n"))
    tasks = max(TASKS, every // TASK)
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    split = members.join(F.broadcast(large), ["d", "cell"], "left").withColumn("block", F.coalesce(own, F.lit(-1)))
    with_each = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y")))
    both = F.when(F.col("_n").isNull(), F.array(F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y")))).otherwise(with_each)
    split = split.withColumn("_at", F.explode(both)).withColumn("task", F.when(F.col("_n").isNull(), F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int")).otherwise(F.col("cell")))
    return split.select("task", F.col("_at.x").alias("x"), F.col("_at.y").alias("y"), "block", *members.columns)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors with a cosine from `threshold` on are linked; n_links counts the other vectors linked
    directly, component_id is the smallest vec_id reachable, and kept says that it is the row's own.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
    do vectors of different lengths with each other. Rows that repeat an id are one vector: of different
    ones, that with the smallest signature counts, for all rows of the id. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("_ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    valid = rows.filter("_ok")
    cells = max(1, min(CELLS, rows.count() // cell))
    several = several_vectors(valid)
    nodes = one_vector_each(valid, several).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight"))
    small_batches(vectors.sparkSession)
    coded = written(nodes.select("embedding", "node", "weight", F.size("embedding").alias("d"), code(F.col("embedding"), cells, threshold).alias("c")).select("embedding", "node", "weight", "d", "c.*"), "codes")
    codes = ["signs", "factor", "low", "step", "levels"]
    key = ["d", "task", "x", "y"]
    members = coded.select("d", F.explode("cells").alias("cell"), "node", *codes)
    doubt = written(dealt(members, block).groupBy(*key).applyInArrow(lambda t: in_doubt(t, threshold), "d int, cell int, node bigint").distinct(), "doubt")
    again = doubt.join(coded.select("node", "weight", "embedding", "cells", *codes), "node")
    found = written(dealt(again, block).groupBy(*key).applyInArrow(lambda t: compared(t, threshold), "node bigint, links bigint, end bigint"), "found")
    links_of = found.filter("end is null").groupBy("node").agg(F.sum("links").alias("links"))
    ends = written(components(found.filter("end is not null").select("node", "end")), "components")
    known = written(coded.select(signature(F.col("embedding")).alias("_sig"), "node", "weight").join(links_of, "node", "left").join(ends, "node", "left").select("_sig", "node", "weight", "links", "component"), "known")
    for t in (coded, doubt, found, ends):
        discard(t)
    own = valid.select("vec_id", signature(F.col("embedding")).alias("_sig"))
    if several is not None:
        own = own.join(several, "vec_id", "left").select("vec_id", F.coalesce("_first", "_sig").alias("_sig"))
    own = own.join(known, "_sig", "left")
    own = own.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    rest = rows.filter("not _ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
