"""Word shingles as 64-bit numbers, and how frequent they are, about, over all documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

#: Words of a shingle.
WORDS = 5
#: Distinct words that a worker keeps with their hashes: the first ones, among them the frequent.
MEMO_ENTRIES = 100_000
#: Counters of the frequency sketch, and the parts that they are added up in.
SKETCH_BITS, SKETCH_PARTS = 20, 16

ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_ENTRIES:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, ascending.

    Words are runs of other bytes than space and \\t to \\r, with A-Z lower-cased. A text with fewer
    words than a shingle has the whole sequence as its one shingle; one without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(word_hashes().__getitem__, found), np.uint64, len(found))
    n = min(words, len(a))
    h = np.full(len(a) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * ODD + a[k : len(a) - n + 1 + k]
    return np.unique(mixed(h))


def bucket(h: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The counter of each shingle."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, text: str = "text", words: int = WORDS, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents have a shingle of each bucket: at least as many as have any one of its shingles.

    Counts cover all documents. Each task counts its own documents, and the tables of the tasks are
    added up in two steps on the executors; the result has the same size for any input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slots = max(8, int(docs.rdd.getNumPartitions() ** 0.5))
    schema = "part int, slot int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(0).to_pylist()]
            if found:
                total += np.bincount(bucket(np.concatenate(found), bits), minlength=1 << bits)
        slot = (TaskContext.get().partitionId() if TaskContext.get() else 0) % slots
        parts = [x.astype("<u4").tobytes() for x in np.split(total, SKETCH_PARTS)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(SKETCH_PARTS), pa.int32()), "slot": pa.array([slot] * SKETCH_PARTS, pa.int32()), "counts": pa.array(parts, pa.binary())})

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SKETCH_PARTS, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u4")
        total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
        return pa.table({"part": rows.column("part").slice(0, 1), "slot": rows.column("slot").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col(text)).mapInArrow(count, schema).groupBy("part", "slot").applyInArrow(added, schema).groupBy("part").applyInArrow(added, schema).collect()
    out = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint32)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()
