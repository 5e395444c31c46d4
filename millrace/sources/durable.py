"""Cutting the lineage of loops in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or one of our own on a local master.

    A cluster must name one: its executors don't share the driver's temporary folders.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and jsc.getCheckpointDir().isDefined():
        named = jsc.getCheckpointDir().get()
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-loops-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table below the shared folder, which dropped() deletes once nothing reads it any more."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path  # type: ignore[attr-defined]
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables of stored(); any other frame is left alone."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
