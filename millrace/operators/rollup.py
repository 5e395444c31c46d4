"""Benchmark roll-ups: headline, scoreboard, repair passes, arms of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.classify import outcome


def headline(rows: DataFrame, named: str) -> DataFrame:
    """One row over a manifest left-joined with results: clean and achievable runs, median errors, errors of one named row.

    Rows: name, expectation, ran (there is a result), clean, errors, pipeline_failed. Impossible rows
    are not achievable; failed pipelines are, but have no error count. The median is exact.
    """
    failed = F.coalesce("pipeline_failed", F.lit(False))
    achievable = (F.col("expectation") != "impossible") & F.col("ran")
    counted = F.when(F.col("ran") & ~failed, F.col("errors"))
    return rows.agg(
        F.count_if(achievable & F.coalesce("clean", F.lit(False))).alias("clean"),
        F.count_if(achievable).alias("achievable"),
        F.median(counted).alias("median_errors"),
        F.max(F.when(F.col("name") == named, counted)).alias("named_errors"),
    )


def scoreboard(rows: DataFrame) -> DataFrame:
    """Cells of the scoreboard: name, verdict, errors, files, with a dash for what isn't there."""
    shown = F.col("ran") & ~F.coalesce("pipeline_failed", F.lit(False))
    verdict = F.when(~F.col("ran"), "not run").otherwise(outcome(F.col("clean"), F.col("pipeline_failed")))
    return rows.select("name", verdict.alias("verdict"), F.when(shown, F.col("errors").cast("string")).otherwise("-").alias("errors"), F.when(shown, F.concat_ws("/", F.col("translated").cast("string"), F.col("total").cast("string"))).otherwise("-").alias("files"))


def markdown(cells: DataFrame) -> str:
    """The scoreboard as a table; a presentation of few rows."""
    rows = cells.orderBy("name").collect()
    return "\n".join(["| " + " | ".join(cells.columns) + " |", "|" + "---|" * len(cells.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows)])


def arms(trials: DataFrame) -> DataFrame:
    """Per arm over trials (item, arm, errors; -1: none): mean of the items' means, least and most."""
    valid = F.when(F.col("errors") >= 0, F.col("errors"))
    items = trials.groupBy("item", "arm").agg(F.avg(valid).alias("mean"), F.min(valid).alias("least"), F.max(valid).alias("most"))
    return items.groupBy("arm").agg(F.avg("mean").alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def passes(counts: DataFrame) -> DataFrame:
    """Errors after each pass (run_id, pass, errors) with the change from the pass before."""
    order = Window.partitionBy("run_id").orderBy("pass")
    return counts.withColumn("change", F.col("errors") - F.lag("errors").over(order))
