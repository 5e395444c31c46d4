"""Bounded repair: check, try a repair, compare, keep or take back, for many projects at once.

A table holds all projects. Each cycle checks those that are still open, repairs them, and checks what came
out; a project's repair is kept only if that is better, else its rows of before stay and it is given up. The
loop ends when nothing is open or after a number of cycles. Every state is a stored table: the one of before is
the snapshot that a project goes back to, and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.verify import repair_accepted
from millrace.sources.durable import dropped, stored

#: Cycles at most, and those of a loop in which a check names one dependency at a time.
CYCLES, DEPENDENCY_CYCLES = 3, 24


def fewer(before: Column, after: Column) -> Column:
    """A repair that leaves strictly fewer issues."""
    return repair_accepted(before.issues, after.issues)


def other(before: Column, after: Column) -> Column:
    """A repair after which the check says something else, or nothing."""
    return (before.issues != after.issues) | (before.told != after.told)


def repaired(state: DataFrame, key: str, check: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame, DataFrame], DataFrame], cycles: int = CYCLES, better: Callable[[Column, Column], Column] = fewer) -> tuple[DataFrame, DataFrame]:
    """The rows of all projects after the loop, and a summary: cycle, key, before, after (issues), kept.

    `check` gives the issues of some projects' rows, with `key` and any other columns; `repair` gives their new
    rows from the rows and the issues, with the same columns. `better` compares what checks came to, structs of
    `issues`, how many, and `told`, a digest of them. A project without issues isn't touched. Rows without a key
    stay as they are. An empty table gives empty tables.
    """

    def counted(issues: DataFrame) -> DataFrame:
        others = sorted(c for c in issues.columns if c != key)
        digest = F.sum(F.pmod(F.xxhash64(*others), F.lit(1 << 40))) if others else F.lit(0).cast("bigint")
        return issues.groupBy(key).agg(F.count("*").alias("issues"), digest.alias("told"))

    now = stored(state, "state")
    issues = stored(check(now), "issues")
    open_ = stored(counted(issues).filter(F.col(key).isNotNull()), "open")
    summaries: list[DataFrame] = []
    for cycle in range(1, cycles + 1):
        if open_.isEmpty():
            break
        own = now.join(open_.select(key), key, "left_semi")
        tried = stored(repair(own, issues.join(open_.select(key), key, "left_semi")).select(*now.columns), "tried")
        found = stored(check(tried), "issues")
        left = counted(found).select(F.col(key).alias("_key"), F.struct("issues", "told").alias("_after"))
        nothing = F.struct(F.lit(0).cast("bigint").alias("issues"), F.lit(0).cast("bigint").alias("told"))
        both = open_.join(left, F.col(key) == F.col("_key"), "left").select(key, F.struct("issues", "told").alias("_before"), F.coalesce("_after", nothing).alias("_after"))
        judged = stored(both.withColumn("kept", better(F.col("_before"), F.col("_after"))), "judged")
        summaries.append(stored(judged.select(F.lit(cycle).cast("bigint").alias("cycle"), key, F.col("_before.issues").alias("before"), F.col("_after.issues").alias("after"), "kept"), "summary"))
        kept = judged.filter("kept").select(key)
        next_ = stored(now.join(kept, key, "left_anti").unionByName(tried.join(kept, key, "left_semi")), "state")
        open_next = stored(judged.filter("kept and _after.issues > 0").select(key, "_after.issues", "_after.told"), "open")
        dropped(now, issues, open_, tried, judged)
        now, issues, open_ = next_, found, open_next
    dropped(issues, open_)
    if not summaries:
        spark = state.sparkSession
        return now, spark.createDataFrame([], "cycle bigint, before bigint, after bigint, kept boolean").withColumn(key, F.lit(None).cast(state.schema[key].dataType)).select("cycle", key, "before", "after", "kept")
    summary = summaries[0]
    for s in summaries[1:]:
        summary = summary.unionByName(s)
    return now, summary


def dependencies_repaired(manifests: DataFrame, log_of: Callable[[DataFrame], DataFrame], cycles: int = DEPENDENCY_CYCLES, mark: str = "# removed: ") -> tuple[DataFrame, DataFrame]:
    """Manifest lines (file, pos, line) without the dependencies that logs can't resolve, and the summary of the loop.

    `log_of` gives the log (run_id, line) of resolving manifests, a run for each file. It may name one dependency
    at a time, so a file takes as many cycles; it is given up when what is named isn't in it.
    """
    from millrace.operators import classify as C

    def check(lines: DataFrame) -> DataFrame:
        return C.unresolvable(log_of(lines)).withColumnRenamed("run_id", "file")

    def strip(lines: DataFrame, bad: DataFrame) -> DataFrame:
        named = bad.select(F.col("file").alias("_file"), F.col("name").alias("_name")).distinct()
        own = F.trim(F.substring_index("line", "=", 1))
        both = lines.join(named, (F.col("file") == F.col("_file")) & (own == F.col("_name")) & F.col("line").contains("="), "left")
        return both.select("file", "pos", F.when(F.col("_name").isNotNull(), F.concat(F.lit(mark), "line")).otherwise(F.col("line")).alias("line"))

    return repaired(manifests, "file", check, strip, cycles, other)
