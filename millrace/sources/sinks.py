"""Writers: appended records, stage checkpoints, keyed upserts, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a list that a report shows.
SHOWN = 40


def append_json(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").json(path)


def write_stage(df: DataFrame, root: str, stage: str) -> None:
    """Replace a stage's checkpoint as a whole: readers see the rows of before or the new ones, never a mixture.

    Rows go to a folder of their own, with a number above all others there, and count once its success marker is
    there, which comes last. So a write that fails leaves the rows of before, and of two writers at once the higher
    number counts; of equal numbers, the later name. The version before stays for those who read it; older ones go.
    """
    spark = df.sparkSession
    number = max([n for n, _, _ in _versions(spark, root, stage)], default=0) + 1
    df.write.parquet(f"{root.rstrip('/')}/{stage}/{number:08}-{uuid.uuid4().hex}")
    whole = [name for _, name, complete in _versions(spark, root, stage) if complete]
    fs, at = _folder(spark, f"{root.rstrip('/')}/{stage}")
    for name in whole[:-2]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, name), True)


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """The rows that a stage's checkpoint holds now."""
    whole = [name for _, name, complete in _versions(spark, root, stage) if complete]
    if not whole:
        raise FileNotFoundError(f"{root}/{stage} has no complete version")
    return spark.read.parquet(f"{root.rstrip('/')}/{stage}/{whole[-1]}")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str, stage: str) -> list[tuple[int, str, bool]]:
    """Versions of a stage in order: number, name, and whether it is complete."""
    fs, at = _folder(spark, f"{root.rstrip('/')}/{stage}")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().split("-")[0].isdigit())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [(int(name.split("-")[0]), name, fs.exists(path(path(at, name), "_SUCCESS"))) for name in names]


def append_history(df: DataFrame, path: str) -> None:
    """Add rows to a history that is never rewritten."""
    df.write.mode("append").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key: the change with the highest order replaces what is there, or is added.

    Both have the same columns. Applying the same changes twice changes nothing.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", "_new")


def report_json(report: DataFrame) -> DataFrame:
    """Per specification of a verification report: its counts and verdict as one JSON text."""
    return report.select("spec", F.to_json(F.struct("matched", "total", "quarantined", "verdict")).alias("json"))


def cases_yaml(cases: DataFrame) -> DataFrame:
    """Per specification: its cases as YAML, by name; what isn't compared exactly is said."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    compare = F.concat_ws(", ", *[F.when(F.col(f"cmp_{k}") != "exact", F.concat(F.lit(f"{k}: "), F.col(f"cmp_{k}"))) for k in ("stdout", "stderr", "exit")])
    one = F.concat(F.lit("- name: "), quoted("name"), F.when(compare != "", F.concat(F.lit("\n  compare: {"), compare, F.lit("}"))).otherwise(""), F.when(F.col("nondeterministic"), "\n  nondeterministic: true").otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("name", one.alias("text"))))
    return cases.groupBy("spec").agg(F.concat(F.lit("cases:\n"), F.array_join(F.transform(listed, lambda x: x.text), "\n"), F.lit("\n")).alias("yaml"))


def summary_json(runs: DataFrame) -> DataFrame:
    """Per run: a JSON summary; the total is what was translated and what failed."""
    return runs.select("run_id", F.to_json(F.struct("run_id", "translated", "failed", (F.col("translated") + F.col("failed")).alias("files_total"))).alias("summary"))


def shown_list(items: DataFrame, key: str, item: str, most: int = SHOWN) -> DataFrame:
    """Per key: the first items in order, joined, and how many more there are."""
    order = Window.partitionBy(key).orderBy(item)
    ranked = items.withColumn("_rank", F.row_number().over(order))
    first = F.filter(F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.col(item)))), lambda x: x.isNotNull())
    return ranked.groupBy(key).agg(F.array_join(first, ",").alias("shown"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def insert_under(lines: DataFrame, header: str, new: str, key: str = "file") -> DataFrame:
    """Texts with a line put right after a section's header, or unchanged without that header."""
    own = F.array_sort(F.collect_list(F.struct("pos", "line")))
    add = lambda x: F.when(F.trim(x.line) == header, F.array(x.line, F.lit(new))).otherwise(F.array(x.line))
    return lines.groupBy(key).agg(F.array_join(F.flatten(F.transform(own, add)), "\n").alias("text"))


def replaced_region(text: Column, path: Column, body: Column) -> Column:
    """A text with the body of one marked region replaced and its markers kept; null without it."""
    begin = F.concat(F.lit("<<<src="), path, F.lit(">>>\n"))
    start = F.position(begin, text)
    head = F.substring(text, F.lit(1), start + F.length(begin) - 1)
    rest = F.substring(text, start + F.length(begin), F.length(text))
    end = F.position(F.lit("<<<end>>>"), rest)
    return F.when((start > 0) & (end > 0), F.concat(head, body, F.lit("\n"), F.substring(rest, end, F.length(rest))))


def stages_done(spark: SparkSession, root: str, stages: list[str]) -> list[str]:
    """Stages that are complete, up to the first one that isn't."""
    done = []
    for stage in stages:
        if not any(complete for _, _, complete in _versions(spark, root, stage)):
            break
        done.append(stage)
    return done


def invalidate_from(spark: SparkSession, root: str, stages: list[str], stage: str) -> None:
    """Remove a stage's checkpoint and all later ones."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in stages[stages.index(stage) :]:
        p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        p.getFileSystem(conf).delete(p, True)
