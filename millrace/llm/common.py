"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts can be long, and a batch is held whole in a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, in rows and bytes, unless the session asks for even less.

    The bounds stay in the session: what an operator returns is planned and run after it has returned,
    and takes its bounds from the session then.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (have and have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; null ids have none."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 4


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for documents that nothing may be learned from; false for a null id."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column | str = "doc_id") -> Column:
    """True for documents that labels may be learned from; false for a null id."""
    return F.coalesce(remainder(doc_id) != 2, F.lit(False))


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) from the columns' values, the same in every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names, or one of our own on a local master.

    A cluster must name one: its executors don't share the driver's temporary folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if named is None and jsc.getCheckpointDir().isDefined():
        named = jsc.getCheckpointDir().get()
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="millrace-checkpoints-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write the rows under the shared folder and read them back.

    The table survives the loss of any executor. Its rows no longer depend on the order in which
    tasks ran, so whatever is derived from it can be computed again and comes out the same.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() once nothing reads it any more; any other frame is left alone.

    What a returned frame still reads stays until the owner of the shared folder clears it.
    """
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


__all__ = [
    "BATCH_ROWS",
    "checkpoint_dir",
    "discard",
    "fresh",
    "held_out",
    "learnable",
    "remainder",
    "small_batches",
    "table",
    "unit_hash",
    "written",
]
