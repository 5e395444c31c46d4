"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """Per node that has a link to another: node, component (the smallest node reachable).

    `links` has two columns with the ends of each link; direction, repeats and loops do not matter, and
    a link with a null end is none. A table without links gives no rows.
    Each round hooks every node with a smaller neighbour to its smallest one, follows the hooks to
    their ends by doubling, and goes on with the links between different ends, so rounds grow with
    the logarithm of the graph. Every step is written to the shared folder: joins read plain tables,
    whose hot keys Spark can split, and a lost executor costs one step.
    """
    a, b = links.columns
    edges = written(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct(), "links")
    rounds: list[DataFrame] = []
    while True:
        hooks = written(edges.groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("end")), "hooks")
        if hooks.isEmpty():
            break
        while True:
            next_ = hooks.select(F.col("node").alias("_at"), F.col("end").alias("_end"))
            jumped = written(hooks.join(next_, F.col("end") == F.col("_at"), "left").select("node", F.coalesce("_end", "end").alias("end"), F.col("_end").isNotNull().alias("moved")), "jumps")
            discard(hooks)
            hooks = jumped
            if not hooks.filter("moved").limit(1).count():
                break
            plain = hooks.select("node", "end")
            plain._millrace_path = jumped._millrace_path
            hooks = plain
        hooks = _only(hooks, "node", "end")
        rounds.append(hooks)
        ends = hooks.select(F.col("node").alias("_at"), F.col("end").alias("_end"))
        mapped = edges.join(ends, F.col("hi") == F.col("_at")).select("lo", F.col("_end").alias("hi"))
        mapped = mapped.join(ends, F.col("lo") == F.col("_at"), "left").select(F.coalesce("_end", "lo").alias("x"), F.col("hi").alias("y"))
        left = written(mapped.filter("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "links")
        discard(edges)
        edges = left
    if not rounds:
        return edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    # what became an end in one round may have been hooked in a later one
    found = rounds[0].select("node", F.col("end").alias("component"))
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("_at"), F.col("end").alias("_end"))
        found = found.join(step, F.col("component") == F.col("_at"), "left").select("node", F.coalesce("_end", "component").alias("component"))
        found = found.unionByName(later.select("node", F.col("end").alias("component")))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))
    return found


def _only(df: DataFrame, *names: str) -> DataFrame:
    out = df.select(*names)
    out._millrace_path = getattr(df, "_millrace_path", None)
    return out
