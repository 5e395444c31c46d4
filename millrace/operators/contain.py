"""Joins of texts with the names they contain, and of paths that end with one another.

Both are joins without an equal key. Names are looked for by an automaton that finds all of them in one
pass over a text; paths get an equal key from the lengths that the shorter side has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.sources.durable import dropped, stored

#: Code points of the names that one automaton holds, about; a tenth of a gigabyte in a worker.
AUTOMATON = 1 << 20
#: Distinct lengths of paths that are listed; beyond, every end of a path is a key.
LENGTHS = 1024

_built: dict[str, object] = {}


def _automaton(block: str, names: Broadcast):
    """The automaton of a block's names, built once in a worker, which holds one at a time."""
    if block not in _built:
        import ahocorasick

        _built.clear()
        found = ahocorasick.Automaton()
        for name in names.value:
            found.add_word(name, name)
        found.make_automaton()
        _built[block] = found
    return _built[block]


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, most: int = AUTOMATON) -> DataFrame:
    """Which names occur in which texts, anywhere and in this very spelling: key, name, each pair of rows of texts and names once.

    Names are counted first. If they fit an automaton they are sent to the executors, and texts are read
    once and not moved. More names go in blocks of about that size, a pass over the texts for each, whose
    rows are stored before the next block is read: the driver and the workers hold one block.

    An empty name is in every text, a null name or text in none; equal names are one. A text's row gives its
    names once each; rows with equal keys are told apart only by their texts. Empty tables give no rows.
    """
    spark = texts.sparkSession
    distinct = names.select(F.col(name).cast("string").alias("_name")).filter("_name is not null").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("_name")), F.lit(0))).first()[0]
    read = texts.select(F.col(key), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    schema = StructType([texts.schema[key], StructField(name, distinct.schema["_name"].dataType)])
    blocks = -(-size // most) if size > most else 1
    if blocks > 1:
        distinct = stored(distinct.withColumn("_block", F.pmod(F.xxhash64("_name"), F.lit(blocks)).cast("int")), "names")

    def found_in(block: int) -> DataFrame:
        own = [r["_name"] for r in (distinct.filter(F.col("_block") == block) if blocks > 1 else distinct).select("_name").collect()]
        every, token = "" in own, uuid.uuid4().hex
        held, empty = spark.sparkContext.broadcast([x for x in own if x]), len(own) == every

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None if empty else _automaton(token, held)
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    seen = {x for _, x in automaton.iter(t)} if automaton else set()
                    if every:
                        seen.add("")
                    rows += [i] * len(seen)
                    hits += sorted(seen)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], [key, name])

        return read.mapInArrow(search, schema)

    if blocks == 1:
        return found_in(0)
    out = stored(found_in(0), "mentions")
    for block in range(1, blocks):
        out = out.unionByName(stored(found_in(block), "mentions"))
    dropped(distinct)
    return out


def mentioned_roots(texts: DataFrame, packages: DataFrame, key: str, text: str) -> DataFrame:
    """Roots of the packages (name, root) that a text names: key, name, root; a name of several roots says nothing."""
    one = packages.groupBy("name").agg(F.min("root").alias("root"), F.max("root").alias("_last")).filter("root = _last").drop("_last")
    return mentions(texts, one, key, text, "name").join(one, "name").select(key, "name", "root")


def _forward(path: str) -> Column:
    return F.translate(path, "\\", "/")


def _ends(longer: DataFrame, shorter: DataFrame, proper: bool) -> DataFrame:
    """Pairs (_a of longer, _b of shorter) where `_x` ends with `_y`; proper: and is not equal to it.

    A path gives a row for each length that the other side has, so a short path such as `mod.rs` meets the
    paths that end with it and no others.
    """
    lengths = [r[0] for r in shorter.select(F.length("_y")).distinct().limit(LENGTHS + 1).collect()]
    most = F.length("_x") - (1 if proper else 0)
    every = F.when(most >= 0, F.sequence(F.lit(0), most)).otherwise(F.array().cast("array<int>"))
    if len(lengths) <= LENGTHS:
        every = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= most)
    asks = longer.select("_a", "_x", F.explode(every).alias("_n")).withColumn("_end", F.when(F.col("_n") == 0, "").otherwise(F.right("_x", "_n")))
    a = asks.select("_a", "_end", F.xxhash64("_end").alias("_key"))
    b = shorter.select("_b", "_y", F.xxhash64("_y").alias("_key"))
    return a.join(b, "_key").filter("_end = _y").select("_a", "_b")


def by_suffix(diags: DataFrame, files: DataFrame, file: str = "file", path: str = "path") -> DataFrame:
    """Diagnostics with each file where one path ends with the other, letter by letter, `\\` read as `/`.

    Distinct paths are matched first, however often they occur; then diagnostics and files are joined to
    the pairs. An empty path is the end of every path, a null one of none; repeated rows give repeated rows.
    """
    a = diags.select(F.col(file).alias("_a")).filter("_a is not null").distinct()
    b = files.select(F.col(path).alias("_b")).filter("_b is not null").distinct()
    down = _ends(a.withColumn("_x", _forward("_a")), b.withColumn("_y", _forward("_b")), False)
    up = _ends(b.select(F.col("_b").alias("_a"), _forward("_b").alias("_x")), a.select(F.col("_a").alias("_b"), _forward("_a").alias("_y")), True)
    pairs = stored(down.unionByName(up.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))), "path-pairs")
    return diags.join(pairs, F.col(file) == F.col("_a")).join(files, F.col("_b") == F.col(path)).drop("_a", "_b")
