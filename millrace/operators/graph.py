"""Dependency graphs: levels of a topological order, and names made unique."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.functions import text as T
from millrace.operators import scan
from millrace.sources.durable import dropped, stored

#: Nodes and edges of a part of a graph that one task queues; a few hundred bytes each.
WHOLE = 500_000
PLACED = StructType([StructField("path", StringType()), *[StructField(c, LongType()) for c in ("level", "root", "nth", "ord")]])


def components(edges: DataFrame) -> DataFrame:
    """Per end of an edge (src, dst): node, component, the smallest end that ways in any direction lead to.

    Each round hangs every node on its smallest smaller neighbour, follows that to the end by doubling, and goes
    on with the edges between different ends, so rounds grow with the logarithm of the graph, chains included.
    """
    left = stored(edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).filter("lo < hi").distinct(), "links")
    rounds: list[DataFrame] = []
    while True:
        ends = stored(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("end")), "hooks")
        if ends.isEmpty():
            break
        while True:
            on = ends.select(F.col("node").alias("_at"), F.col("end").alias("_next"))
            moved = stored(ends.join(on, F.col("end") == F.col("_at"), "left").select("node", F.coalesce("_next", "end").alias("end"), F.col("_next").isNotNull().alias("moved")), "hooks")
            dropped(ends)
            ends = moved
            if ends.filter("moved").isEmpty():
                break
        rounds.append(ends)
        to = lambda name: ends.select(F.col("node").alias(f"_{name}"), F.col("end").alias(f"_{name}_end"))
        both = left.join(to("hi"), F.col("hi") == F.col("_hi")).join(to("lo"), F.col("lo") == F.col("_lo"), "left")
        both = both.select(F.coalesce("_lo_end", "lo").alias("a"), F.col("_hi_end").alias("b")).filter("a <> b")
        rest = stored(both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
        dropped(left)
        left = rest
    if not rounds:
        return left.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    found = rounds[0].select("node", F.col("end").alias("component"))
    for later in rounds[1:]:
        on = later.select(F.col("node").alias("_at"), F.col("end").alias("_next"))
        found = found.join(on, F.col("component") == F.col("_at"), "left").select("node", F.coalesce("_next", "component").alias("component")).unionByName(later.select("node", F.col("end").alias("component")))
    found = stored(found.unionByName(found.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component")), "components")
    dropped(left, *rounds)
    return found


def queue_order(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Per node (path, ord): path, level, and place, its place from 0 in the order of a queue.

    Nodes that depend on nothing enter the queue by `ord`; any other enters when the last of its
    dependencies leaves it, and of those that one node frees the first by `ord`. Level is 0 for what
    depends on nothing, else one above the highest dependency. Nodes on a cycle, and all that depend on
    one, have level null and come last, by `ord`. Edges (src, dst) count once, if both ends are nodes;
    those from a node to itself don't. Equal `ord`s are in the order of paths.

    A queue gives all of a level before any of the next, and within a level the order of what freed them,
    back to the node without dependencies that the way began at. Nodes that nothing depends on free none: as long
    as they are half of all, they are left out, and take their places after what frees them once that has its own.
    Parts of the rest that nothing joins are queued each for itself, and put together by level, that beginning's
    `ord`, and their own order. A part of up to `whole` nodes and edges is queued in one task, chains of any length in
    one go; a larger one level by level, until so few are left. Jobs grow with the logarithm of the graph, and with the
    levels of large parts only.
    """
    nodes = stored(nodes.groupBy("path").agg(F.min("ord").cast("bigint").alias("ord")), "nodes")
    own = nodes.select(F.col("path").alias("dst"))
    edges = stored(edges.filter("src <> dst").select("src", "dst").distinct().join(own, "dst", "left_semi").join(own.withColumnRenamed("dst", "src"), "src", "left_semi"), "edges")
    return _ordered(nodes, edges, whole)


def _ordered(nodes: DataFrame, edges: DataFrame, whole: int) -> DataFrame:
    """What queue_order() gives for stored nodes and edges between them, which it deletes."""
    used = stored(edges.select(F.col("dst").alias("path")).distinct(), "used")
    n = used.count()
    if not n or 2 * n > nodes.count():
        dropped(used)
        return _by_parts(nodes, edges, whole)
    core = stored(nodes.join(used, "path", "left_semi"), "nodes")
    inner = stored(edges.join(used.withColumnRenamed("path", "src"), "src", "left_semi"), "edges")
    dropped(used)
    before = stored(_ordered(core, inner, whole).select(F.col("path").alias("dst"), "level", "place"), "order")
    stuck = F.max(F.col("level").isNull()).alias("_stuck")
    freed = edges.join(before, "dst").groupBy(F.col("src").alias("path")).agg(stuck, F.max("level").alias("_level"), F.max("place").alias("_by"))
    level = F.when(F.col("_stuck").isNull(), F.lit(0).cast("bigint")).when(~F.col("_stuck"), F.col("_level") + 1)
    every = nodes.join(freed, "path", "left").select("path", "ord", level.alias("level"), F.col("_by").alias("by"))
    placed = scan.placed(every, [], [F.col("level").isNull(), "level", F.when(F.col("level").isNotNull(), F.col("by")), "ord", "path"])
    dropped(nodes, edges, before)
    return _numbered(placed)


def _numbered(placed: DataFrame) -> DataFrame:
    """Placed nodes with their place from 0."""
    return scan.running(placed, [], place=("sum", F.lit(1).cast("bigint"))).select("path", "level", (F.col("place") - 1).alias("place"))


def _by_parts(nodes: DataFrame, edges: DataFrame, whole: int) -> DataFrame:
    """What _ordered() gives, part by part."""
    parts = components(edges)
    at = parts.select(F.col("node").alias("path"), "component")
    sized = edges.select(F.col("src").alias("path")).join(at, "path").groupBy("component").count()
    large = stored(sized.join(at.groupBy("component").agg(F.count("*").alias("_nodes")), "component").filter(F.col("count") + F.col("_nodes") > whole).select("component"), "large")

    told = nodes.join(at, "path", "left").select("path", "ord", F.coalesce("component", "path").alias("component"))
    lone = told.join(at.select("path"), "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("level"), F.col("ord").cast("bigint").alias("root"), F.lit(0).cast("bigint").alias("nth"), F.col("ord").cast("bigint").alias("ord"))
    joined = told.join(at.select("path"), "path", "left_semi").join(large, "component", "left_anti")
    rows = joined.select("component", "path", F.lit(None).cast("string").alias("dst"), F.col("ord").cast("bigint").alias("ord"))
    rows = rows.unionByName(edges.withColumnRenamed("src", "path").join(at, "path").join(large, "component", "left_anti").select("component", "path", "dst", F.lit(None).cast("bigint").alias("ord")))
    queued = stored(rows.groupBy("component").applyInArrow(_queued, PLACED), "queued")
    every = lone.unionByName(queued)
    if not large.isEmpty():
        inside = lambda df, name: df.join(at.join(large, "component", "left_semi").select(F.col("path").alias(name)), name, "left_semi")
        every = every.unionByName(_by_level(inside(nodes, "path"), inside(edges, "src"), whole))
    order = [F.col("level").isNull(), "level", F.when(F.col("level").isNotNull(), F.col("root")).otherwise(F.col("ord")), F.when(F.col("level").isNotNull(), F.col("nth")), "path"]
    placed = scan.placed(every, [], order)
    dropped(nodes, edges, parts, large, queued)
    return _numbered(placed)


def _queued(rows: pa.Table) -> pa.Table:
    """A part's nodes (without `dst`) and edges as a queue gives them."""
    paths, ends, ords = (rows.column(c).to_pylist() for c in ("path", "dst", "ord"))
    names = sorted((o, p) for p, d, o in zip(paths, ends, ords, strict=True) if d is None)
    place = {p: i for i, (_, p) in enumerate(names)}
    n = len(names)
    users: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    for a, b in sorted((place[p], place[d]) for p, d in zip(paths, ends, strict=True) if d is not None):
        users[b].append(a)
        waits[a] += 1
    level, root, order = [None] * n, [names[i][0] for i in range(n)], []
    for i in range(n):
        if not waits[i]:
            level[i] = 0
            order.append(i)
    for i in order:  # grows as nodes are freed
        for u in users[i]:
            waits[u] -= 1
            if not waits[u]:
                level[u], root[u] = level[i] + 1, root[i]
                order.append(u)
    nth = [0] * n
    for k, i in enumerate(order):
        nth[i] = k
    return pa.table({"path": pa.array([p for _, p in names], pa.string()), "level": pa.array(level, pa.int64()), "root": pa.array(root, pa.int64()), "nth": pa.array(nth, pa.int64()), "ord": pa.array([o for o, _ in names], pa.int64())})


def _by_level(nodes: DataFrame, edges: DataFrame, whole: int) -> DataFrame:
    """Nodes of large parts, a level in each round; when no more than `whole` nodes and edges can still be freed, they go to one task."""
    waits = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("waits"))
    left = stored(nodes.join(waits, "path", "left").select("path", F.col("ord").cast("bigint").alias("ord"), F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).cast("bigint").alias("last"), F.col("ord").cast("bigint").alias("root")), "open")
    done: list[DataFrame] = []
    while True:
        ready = stored(left.filter("waits = 0").orderBy("last", "ord", "path").withColumn("nth", F.monotonically_increasing_id()), "ready")
        if ready.isEmpty():
            break
        done.append(ready.select("path", F.lit(len(done)).cast("bigint").alias("level"), "root", "nth", "ord"))
        freed = edges.join(ready.select(F.col("path").alias("dst"), "nth", "root"), "dst").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("_freed"), F.max("nth").alias("_at"), F.max_by("root", "nth").alias("_root"))
        rest = left.filter("waits > 0").join(freed, "path", "left")
        still = stored(rest.select("path", "ord", (F.col("waits") - F.coalesce("_freed", F.lit(0))).alias("waits"), F.coalesce("_at", "last").alias("last"), F.coalesce("_root", "root").alias("root")), "open")
        dropped(left)
        left = still
        if left.count() <= whole and (inner := edges.join(left.select(F.col("path").alias("src")), "src", "left_semi").join(left.select(F.col("path").alias("dst")), "dst", "left_semi")).count() <= whole:
            done.append(_rest(left, inner, len(done)))
            return _stacked(done)
    done.append(left.select("path", F.lit(None).cast("bigint").alias("level"), "root", F.lit(0).cast("bigint").alias("nth"), "ord"))
    return _stacked(done)


def _rest(left: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """The few open nodes of a queue (path, ord, waits, last, root), of which some are free now, in one task."""

    def queue(rows: pa.Table) -> pa.Table:
        own = sorted((r for r in rows.to_pylist() if r["dst"] is None), key=lambda r: (r["ord"], r["path"]))
        place = {r["path"]: i for i, r in enumerate(own)}
        users: list[list[int]] = [[] for _ in own]
        for a, b in sorted((place[r["path"]], place[r["dst"]]) for r in rows.to_pylist() if r["dst"] is not None):
            users[b].append(a)
        waits, root = [r["waits"] for r in own], [r["root"] for r in own]
        levels: list[int | None] = [None] * len(own)
        order = sorted((i for i, w in enumerate(waits) if not w), key=lambda i: (own[i]["last"], i))
        for i in order:
            levels[i] = level
        for i in order:
            for u in users[i]:
                waits[u] -= 1
                if not waits[u]:
                    levels[u], root[u] = levels[i] + 1, root[i]
                    order.append(u)
        nth = [0] * len(own)
        for k, i in enumerate(order):
            nth[i] = k
        return pa.table({"path": pa.array([r["path"] for r in own], pa.string()), "level": pa.array(levels, pa.int64()), "root": pa.array(root, pa.int64()), "nth": pa.array(nth, pa.int64()), "ord": pa.array([r["ord"] for r in own], pa.int64())})

    none = F.lit(None)
    rows = left.select(F.lit(0).alias("one"), "path", none.cast("string").alias("dst"), "ord", "waits", "last", "root")
    rows = rows.unionByName(edges.select(F.lit(0).alias("one"), F.col("src").alias("path"), "dst", *[none.cast("bigint").alias(c) for c in ("ord", "waits", "last", "root")]))
    return stored(rows.groupBy("one").applyInArrow(queue, PLACED), "queued")


def _stacked(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node (path): its level, 0 for what depends on nothing, else one above its highest dependency.

    Nodes on a cycle, and all that depend on one, get null: they come last.
    """
    return queue_order(nodes.select("path", F.lit(0).alias("ord")), edges).select("path", "level")


def first_in_first_out(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """The exact order of a queue for a graph that fits the driver; nodes never freed come last, in input order."""
    waits = dict.fromkeys(nodes, 0)
    users: dict[str, list[str]] = {n: [] for n in nodes}
    for src, dst in dict.fromkeys(edges):
        if src in waits and dst in waits:
            waits[src] += 1
            users[dst].append(src)
    queue, out = deque(n for n in nodes if not waits[n]), []
    while queue:
        n = queue.popleft()
        out.append(n)
        for u in users[n]:
            waits[u] -= 1
            if not waits[u]:
                queue.append(u)
    seen = set(out)
    return out + [n for n in nodes if n not in seen]


def unique_names(names: DataFrame) -> DataFrame:
    """Names (name, path, ord) made unique, as if rows chose one after another by `ord`.

    A row takes its name if no earlier row has it, else the shortest end of its path, two segments or
    more joined by `_`, that none has, else its name with the first number from 2 on that none has.
    `ord` must be unique. Paths' segments are made identifiers first.

    All rows choose at once: a name that several want goes to the first of them, and the others try
    their next choice, until nobody is turned away. That gives what choosing in turn gives, since a
    name is only ever taken over by an earlier row. Rows that are down to numbers skip those that
    earlier ones of their name use up, so rounds grow with the paths' depth, not with the rows.
    """
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: ~x.isin("", ".", "..")), T.identifier)
    ends = F.when(F.size(segments) >= 2, F.transform(F.sequence(F.lit(2), F.size(segments)), lambda n: F.array_join(F.slice(segments, -n, n), "_"))).otherwise(F.array().cast("array<string>"))
    open_ = stored(names.select("name", "path", "ord", F.concat(F.array("name"), ends).alias("choices"), F.lit(0).alias("tried"), F.lit(2).cast("bigint").alias("number")), "names")
    while True:
        numbered = F.col("tried") >= F.size("choices")
        earlier = F.row_number().over(Window.partitionBy("name").orderBy("ord")) - 1
        down = open_.filter(numbered).withColumn("number", F.greatest(F.col("number"), earlier + 2))
        asked = open_.filter(~numbered).unionByName(down).withColumn("unique", F.when(numbered, F.concat_ws("_", "name", F.col("number").cast("string"))).otherwise(F.get("choices", F.col("tried"))))
        first = asked.groupBy("unique").agg(F.min("ord").alias("_first"))
        settled = stored(asked.join(first, "unique").withColumn("_lost", F.col("ord") > F.col("_first")), "names")
        dropped(open_)
        if settled.filter("_lost").isEmpty():
            return settled.select("name", "path", "ord", "unique")
        lost = F.col("_lost")
        open_ = stored(settled.select("name", "path", "ord", "choices", F.when(lost & ~numbered, F.col("tried") + 1).otherwise(F.col("tried")).alias("tried"), F.when(lost & numbered, F.col("number") + 1).otherwise(F.col("number")).alias("number")), "names")
        dropped(settled)
