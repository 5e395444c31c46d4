"""Nearest neighbours by one vantage-point tree for each shard of the vectors.

A vector belongs to the nearest of some pivots; a pivot's vectors are a shard, or several by hash if
they are many. Each shard's tree is built once, in the pass in which every query asks its own shard,
and kept as a row. With the distance of its k-th neighbour there, a query then goes to all other
shards that the triangle inequality lets hold a nearer one, by the pivots' distances and how far a
pivot's vectors lie. Trees and queries stream through tasks: a task holds one tree and one batch.

In a tree, a subtree is passed over when the triangle inequality says that nothing in it can be nearer
than the query's k-th so far. Both bounds are multiplied by `factor`: one keeps the search exact, less
prunes more and may miss some.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, unit_hash, written

#: Vectors of a shard, about.
SHARD = 65536
#: Pivots at least, so that small tables use several tasks too, and at most, which bounds what is broadcast.
PIVOTS_LEAST, PIVOTS_MOST = 8, 4096
#: Vectors of a leaf.
LEAF = 96
#: Share of the distance to the k-th neighbour that pruning respects.
FACTOR = 1.0
#: Bounds are loosened by this share of the distances they come from, against rounding.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def signature(vector: Column | str) -> Column:
    """128 bits that stand for a vector in joins, so that vectors aren't compared there."""
    return F.struct(F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(77), vector).alias("b"))


def several_vectors(rows: DataFrame) -> DataFrame | None:
    """Ids (vec_id) of rows that have different vectors, with the signature of the one that counts, `_first`; null if there are none.

    An id stands for one vector: of different ones, that with the smallest signature, in any order of rows.
    """
    sig = signature("embedding")
    found = written(rows.groupBy("vec_id").agg(F.min(sig).alias("_first"), F.max(sig).alias("_last")).filter("_first <> _last").select("vec_id", "_first"), "several")
    if not found.isEmpty():
        return found
    discard(found)
    return None


def one_vector_each(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """Rows (vec_id, embedding) whose vector is the one that counts for its id."""
    if several is None:
        return rows
    return rows.join(several, "vec_id", "left").filter(F.col("_first").isNull() | (F.col("_first") == signature("embedding"))).drop("_first")


@dataclass
class Node:
    """A vantage point with the ranges of distances inside and outside its median, or a leaf's rows."""

    rows: np.ndarray
    point: int = -1
    inner: Node | None = None
    outer: Node | None = None
    ranges: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in their order."""
    q = q.astype(np.float64)
    total = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        step = q[:, k, None] - x[None, :, k]
        step *= step
        total += step
    return np.sqrt(total)


class Tree:
    """Vectors with their ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.ids = x, ids
        self.computed = 0
        self.root = Node(np.arange(0))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                node.rows = rows
                continue
            # the row that lies farthest from the mean sees the others at the most varied distances
            own = x[rows]
            at = int(((own - own.mean(0)) ** 2).sum(1).argmax())
            node.point, rest = int(rows[at]), np.delete(rows, at)
            d = distances(x[node.point][None], x[rest])[0]
            order = np.argsort(d, kind="stable")
            half = len(rest) // 2
            near, far = order[:half], order[half:]
            node.ranges = d[near[0]], d[near[-1]], d[far[0]], d[far[-1]]
            node.inner, node.outer = Node(rest[near]), Node(rest[far])
            todo += [(node.inner, rest[near]), (node.outer, rest[far])]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest other than the row with its own id, nearest
        first, ties to the smaller id; infinity where there are fewer."""
        best = np.full((len(q), k), np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)

        def offer(active: np.ndarray, rows: np.ndarray, d: np.ndarray | None = None) -> None:
            if d is None:
                d = distances(q[active], self.x[rows])
                self.computed += d.size
            d = np.where(self.ids[rows][None] == own[active, None], np.inf, d)
            hit = np.flatnonzero((d <= best[active, -1:]).any(1))
            if not len(hit):
                return
            active, d = active[hit], d[hit]
            m = min(k, d.shape[1])
            if d.shape[1] > 4 * k:  # all that can be among the k nearest, ties included
                bound = np.partition(d, m - 1, 1)[:, m - 1 : m]
                width = int((d <= bound).sum(1).max())
                few = np.argsort(d, 1, kind="stable")[:, :width]
                names, d = self.ids[rows][few], np.take_along_axis(d, few, 1)
            else:
                names = np.broadcast_to(self.ids[rows], d.shape)
            d, names = np.concatenate([best[active], d], 1), np.concatenate([who[active], np.where(np.isinf(d), np.iinfo(np.int64).max, names)], 1)
            order = np.lexsort((names, d), axis=-1)[:, :k]
            best[active], who[active] = np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)

        # first each query goes down to its nearest leaf only, for a first bound
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, active = todo.pop()
            if not len(active):
                continue
            if node.point < 0:
                if len(node.rows):
                    offer(active, node.rows)
                continue
            inside = distances(q[active], self.x[[node.point]])[:, 0] <= (node.ranges[1] + node.ranges[2]) / 2
            todo += [(node.inner, active[inside]), (node.outer, active[~inside])]
        bound = best[:, -1].copy()
        best[:], who[:] = np.inf, np.iinfo(np.int64).max
        # then all walk the tree together, leaving subtrees out by the better of both bounds
        todo = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            node, active, least = todo.pop()
            keep = least <= factor * np.minimum(best[active, -1], bound[active]) * (1 + SLACK)
            active = active[keep]
            if not len(active):
                continue
            if node.point < 0:
                if len(node.rows):
                    offer(active, node.rows)
                continue
            d = distances(q[active], self.x[[node.point]])
            self.computed += d.size
            offer(active, np.array([node.point]), d)
            lo_in, hi_in, lo_out, hi_out = node.ranges
            d = d[:, 0]
            loose = SLACK * (d + hi_out)
            todo.append((node.outer, active, np.maximum(lo_out - d, d - hi_out) - loose))
            todo.append((node.inner, active, np.maximum(lo_in - d, d - hi_in) - loose))
        return best, who


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (rows, vectors) for each length of a column of vectors."""
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(width)])
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield rows, flat[start[rows][:, None] + np.arange(w)]


class Pivots:
    """Pivots by length of vectors, and of each its shards and how far its vectors lie.

    A length that no pivot was picked for has one cell, -1, that is never passed over.
    """

    def __init__(self, points: dict[int, np.ndarray]):
        self.points = points
        self.radius: dict[tuple[int, int], float] = {}
        self.shards: dict[tuple[int, int], int] = {}

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and its distance."""
        p = self.points.get(x.shape[1])
        if p is None:
            return np.full(len(x), -1), np.zeros(len(x))
        d = distances(x, p)
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at]

    def routes(self, x: np.ndarray, bound: np.ndarray, factor: float) -> list[list[int]]:
        """The cells that can hold a vector nearer to each query than its bound, as (cell, shard) pairs flattened."""
        w = x.shape[1]
        cells = np.array(sorted(c for d, c in self.shards if d == w), np.int64)
        if not len(cells):
            return [[] for _ in x]
        if w in self.points:
            d = distances(x, self.points[w])
            near = d.min(1, keepdims=True)
            own = d[:, cells]
            radius = np.array([self.radius[w, c] for c in cells.tolist()])
            # a vector of a cell is no farther from its pivot than the radius, nor than from any other pivot
            least = np.maximum(own - radius, (own - near) / 2) - SLACK * (own + radius)
            open_ = least <= factor * bound[:, None] * (1 + SLACK)
        else:
            open_ = np.ones((len(x), len(cells)), bool)
        each = [[(c, s) for s in range(self.shards[w, c])] for c in cells.tolist()]
        return [[v for k in np.flatnonzero(row) for pair in each[k] for v in pair] for row in open_]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """Each query's k nearest vectors by Euclidean distance in double precision.

    Both tables have vec_id and embedding. Returns query_id, rank (from 1), vec_id, score (the
    distance), nearest first and ties to the smaller vec_id; fewer rows where there are fewer
    candidates. A vector isn't a neighbour of queries with its own vec_id. Vectors and queries that are
    null, empty, zero, or hold null or non-finite components, or have a null id, take no part, and
    vectors of another length than the query's aren't its candidates. Repeated rows count once; of rows
    of one id with different vectors, those of the vector with the smallest signature count. Other columns are not read, so clashing names do not matter.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    own, asked = clean(vectors), clean(queries).dropDuplicates(["vec_id", "embedding"])
    several = several_vectors(own)
    own, asked = one_vector_each(own, several), one_vector_each(asked, several_vectors(asked))
    total = vectors.count()
    wanted = min(PIVOTS_MOST, max(PIVOTS_LEAST, -(-total // shard)))
    # about twice as many by hash, of which the first by hash are taken: the same in every run
    picked = own.withColumn("_h", unit_hash("vec_id", F.lit(3))).filter(F.col("_h") < 2.0 * wanted / max(1, total)).orderBy("_h", "vec_id").limit(wanted).select("embedding").collect()
    points: dict[int, list] = {}
    for r in picked:
        points.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = Pivots({w: np.unique(np.array(v, np.float64), axis=0) for w, v in points.items()})

    @F.arrow_udf("struct<cell: int, away: double>")
    def placed(embedding: pa.Array) -> pa.Array:
        cell, away = np.zeros(len(embedding), np.int32), np.zeros(len(embedding))
        for rows, x in vectors_of(embedding):
            cell[rows], away[rows] = pivots.cells(x)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], ["cell", "away"])

    dealt = written(own.select("vec_id", "embedding", F.size("embedding").alias("d"), placed("embedding").alias("p")).select("vec_id", "embedding", "d", "p.*"), "placed")
    for r in dealt.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # at most a row for each pivot and length
        pivots.radius[r["d"], r["cell"]] = r["radius"]
        pivots.shards[r["d"], r["cell"]] = -(-r["n"] // shard)
    sizes = spark.createDataFrame([(d, c, n) for (d, c), n in pivots.shards.items()], "d int, cell int, shards int")
    key = ["d", "cell", "shard"]
    sub = lambda seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("shards")).cast("int").alias("shard")
    none = lambda kind: F.lit(None).cast(kind)
    left = dealt.join(F.broadcast(sizes), ["d", "cell"]).select("d", "cell", sub(0), F.lit(False).alias("asks"), "vec_id", "embedding")
    home = asked.select("vec_id", "embedding", F.size("embedding").alias("d"), placed("embedding").alias("p")).select("vec_id", "embedding", "d", "p.cell").join(F.broadcast(sizes), ["d", "cell"], "left")
    home = home.select("d", "cell", F.coalesce(sub(7), F.lit(0)).alias("shard"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard, vectors before queries, to answers and the shard's tree."""
        now, held, tree, kind = None, [], None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if now is not None and (tree is not None or held):
                yield answers(now, kind, tree=pickle.dumps(tree or grown(held), 5))

        for shard_, part in runs(batches, key):
            if shard_ != now:
                yield from ended()
                now, held, tree, kind = shard_, [], None, part.column("embedding").type
            asks = part.column("asks").to_numpy(zero_copy_only=False)
            if not asks.all():
                held.append(part.filter(pa.array(~asks)).select(["vec_id", "embedding"]))
            if asks.any():
                tree, held = tree or (grown(held) if held else None), []
                yield asked_of(now, tree, part.filter(pa.array(asks)), k, factor, home=True)
        yield from ended()

    kind = own.schema["embedding"].dataType.simpleString()
    schema = f"d int, cell int, shard int, tree binary, query_id bigint, embedding {kind}, bound double, found array<struct<vec_id: bigint, score: double>>"
    first = written(left.unionByName(home).repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(build, schema), "trees")

    @F.arrow_udf("array<int>")
    def routed(embedding: pa.Array, bound: pa.Array) -> pa.Array:
        out: list = [None] * len(embedding)
        b = bound.to_numpy(zero_copy_only=False)
        for rows, x in vectors_of(embedding):
            for at, route in zip(rows, pivots.routes(x, b[rows], factor), strict=True):
                out[at] = route
        return pa.array(out, pa.list_(pa.int32()))

    went = first.filter("tree is null")
    route = F.transform(F.sequence(F.lit(0), F.size("_r") - 2, F.lit(2)), lambda i: F.struct(F.get("_r", i).alias("cell"), F.get("_r", i + 1).alias("shard")))
    more = went.withColumn("_r", routed("embedding", "bound")).filter(F.size("_r") > 0)
    more = more.select("d", "query_id", "embedding", "bound", F.col("cell").alias("_cell"), F.col("shard").alias("_shard"), F.explode(route).alias("_to")).filter("_to.cell <> _cell or _to.shard <> _shard")
    more = more.select("d", "_to.cell", "_to.shard", none("binary").alias("tree"), F.col("query_id").alias("vec_id"), "embedding", "bound")
    trees = first.filter("tree is not null").select(*key, "tree", none("bigint").alias("vec_id"), none(kind).alias("embedding"), none("double").alias("bound"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard, its tree before queries, to answers."""
        now, tree = None, None
        for shard_, part in runs(batches, key):
            if shard_ != now:
                now, tree = shard_, None
            if tree is None and part.column("tree")[0].is_valid:
                tree = pickle.loads(part.column("tree")[0].as_py())
                part = part.slice(1)
            if len(part):
                yield asked_of(now, tree, part, k, factor, home=False)

    second = trees.unionByName(more).repartition(*key).sortWithinPartitions(*key, F.col("tree").isNull()).mapInArrow(search, schema)
    found = went.select("query_id", "found").unionByName(second.select("query_id", "found")).select("query_id", F.explode("found").alias("f")).select("query_id", "f.*")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = written(ranked, "nearest")
    for t in (dealt, first):
        discard(t)
    return out


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of sorted batches, by key, in order."""
    for batch in batches:
        if not len(batch):
            continue
        at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tuple(at[a].tolist()), batch.slice(a, b - a)


def grown(held: list[pa.RecordBatch]) -> Tree:
    """The tree of rows (vec_id, embedding); rows that are the same in both count once."""
    rows = pa.Table.from_batches(held)
    ids = rows.column("vec_id").to_numpy()
    x = next(vectors_of(rows.column("embedding").combine_chunks()))[1]
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    again = np.zeros(len(ids), bool)
    cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1, append=ids[-1] + 1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1:
            again[a:b] = True
            again[a + np.unique(x[a:b], axis=0, return_index=True)[1]] = False
    return Tree(x[~again], ids[~again])


def asked_of(now: tuple, tree: Tree | None, part: pa.RecordBatch, k: int, factor: float, home: bool) -> pa.RecordBatch:
    """What a shard's tree answers; asked at home, a query comes along with the distance of its k-th."""
    ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
    if tree is None:
        d, who = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
    else:
        d, who = tree.search(next(vectors_of(part.column("embedding")))[1].astype(np.float64), ids, k, factor)
    found = [[{"vec_id": int(v), "score": float(s)} for v, s in zip(w, e, strict=True) if np.isfinite(s)] for w, e in zip(who, d, strict=True)]
    vectors = part.column("embedding")
    return answers(now, vectors.type, query_id=ids, found=found, embedding=vectors if home else None, bound=d[:, -1] if home else None)


def answers(now: tuple, kind: pa.DataType, tree: bytes | None = None, query_id=None, found=None, embedding=None, bound=None) -> pa.RecordBatch:
    n = 1 if query_id is None else len(query_id)
    columns = [pa.array([v] * n, pa.int32()) for v in now] + [pa.array([tree] * n, pa.binary()), pa.array(query_id if query_id is not None else [None], pa.int64())]
    columns += [embedding if embedding is not None else pa.nulls(n, kind), pa.array(bound) if bound is not None else pa.nulls(n, pa.float64())]
    columns += [pa.array(found if found is not None else [None], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))]
    return pa.RecordBatch.from_arrays(columns, ["d", "cell", "shard", "tree", "query_id", "embedding", "bound", "found"])
