"""Packing documents into sequences of fixed length by best-two-fit.

Documents are encoded where they lie; only a piece's length matters for packing. Because lengths are
whole numbers up to the capacity, the packing is planned over the histogram of lengths, which has at
most `capacity` entries whatever the number of documents: each step fills one bin greedily with the
longest lengths that fit, then tries to replace its smallest document by two unpacked ones that fill
the widened gap more tightly, and repeats the finished bin as often as the remaining counts allow,
which is what filling bin by bin would do. The plan says which ranks of a length go where, and ranks
come from counts by (length, hash bucket), so no task ever holds all pieces of a length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bytebpe import LETTERS, NUMBERS, SPACE, json_tokenizer
from millrace.llm.common import small_batches, written

CAPACITY = 2048
#: Distinct words that each of a worker's two dictionaries of ids holds.
MEMO_ENTRIES = 150_000
#: Bits of the table of marks of words that came once.
SEEN_BITS = 21
#: Hash buckets that each length's pieces are ranked in, at least, and pieces for which one more is taken.
RANK_BUCKETS, BUCKET_ROWS = 64, 200_000

#: What the direct path takes: code points whose lower case stays below U+0250 and that NFC leaves alone.
DIRECT = re.compile("[^\\x00-\\x1b\\x20-\\u017f]")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


#: Numbers to little-endian 32-bit ones, by how many there are.
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


class WordIds(dict):
    """The ids of words, as bytes, computed once each while they are in use.

    A word is kept when it comes for the second time: of its first, only a mark stays. A full dictionary
    becomes the old one, from which words that come again are taken over.
    """

    def __init__(self, path: str, entries: int):
        tok = json_tokenizer(path)
        self.entries, self.old, self.seen = entries, {}, bytearray(1 << SEEN_BITS)
        self.tokenize = tok.model.tokenize
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+").findall
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isascii() and word.isalpha():
                ids = [t.id for t in self.tokenize(word)]
            else:
                ids = [t.id for piece in self.split(word) for t in self.tokenize(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters))]
            found = PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else struct.pack(f"<{len(ids)}I", *ids)
            h = hash(word)
            slot, mark = h & (1 << SEEN_BITS) - 1, h >> 40 & 255 | 1
            if self.seen[slot] != mark:
                self.seen[slot] = mark
                return found
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class WordEncoder:
    """Ids of texts for a tokenizer that lower-cases, drops white space and never merges across words.

    A text is cut at white space, and the ids of each distinct word are computed once by the
    library's pattern and model, then kept as bytes. A text with rarer characters or with strings of
    added tokens goes through the library as a whole.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self.tok = json_tokenizer(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.ids = WordIds(path, entries)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if DIRECT.search(text) or (self.added is not None and self.added.search(text)):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, text.lower().split()))


#: What a file must say of its tokenizer for WordEncoder to give what the library gives.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_at_words(path: str) -> bool:
    """Whether a file is of a tokenizer that WordEncoder encodes for."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    before = told.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", []) if before.get("type") == "Sequence" else []
    bytes_ = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
    model = told["model"]
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    plain = all(not t[k] for t in told.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and whole and bytes_ and steps[0] == SPLIT and (told.get("normalizer") or {}).get("normalizers") == NORMALIZERS


class TextEncoder:
    """Ids of texts for any other tokenizer of the library, text by text."""

    def __init__(self, path: str):
        self.tok = json_tokenizer(path)

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | TextEncoder:
    return WordEncoder(path) if splits_at_words(path) else TextEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and with `ids` the ids themselves.

    A document is its ids and then `end_id`; null and empty texts are `end_id` alone. Only documents
    longer than `capacity` are cut. Repeated rows give pieces each, and an empty table none. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at, piece, length, crc, parts = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = enc.encode(text or "") + end
                for k in range(0, len(data), step):
                    part = data[k : k + step]
                    at.append(row)
                    piece.append(k // step)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int64))
            n = np.array(piece, np.int64)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n.astype(np.int32)), pa.array(n * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(parts, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Lengths:
    """How many pieces of each length are unpacked, with the lengths that remain as bits of a number."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.bits = sum(1 << n for n, c in counts.items() if c > 0)

    def longest(self, most: int) -> int:
        """The longest unpacked length up to `most`; 0 if none."""
        return max(0, (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def add(self, length: int, n: int) -> None:
        self.count[length] = self.count.get(length, 0) + n
        if self.count[length] > 0:
            self.bits |= 1 << length
        else:
            self.bits &= ~(1 << length)

    def two(self, least: int, most: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is as near to `most` as can be, and over `least`."""
        best, found, a = least, None, self.longest(most - 1)
        while a and 2 * a > best:
            self.add(a, -1)
            b = self.longest(min(a, most - a))
            self.add(a, 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
            a = self.longest(a - 1)
        return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins for so many pieces of each length: (lengths in a bin, how many such bins)."""
    left, out = Lengths(counts), []
    while left.bits:
        packed: list[int] = []
        gap = capacity
        while n := left.longest(gap):
            left.add(n, -1)
            packed.append(n)
            gap -= n
        while gap and packed:
            smallest = packed[-1]
            pair = left.two(smallest, smallest + gap)
            if pair is None:
                break
            left.add(smallest, 1)
            packed.pop()
            for n in pair:
                left.add(n, -1)
            packed = sorted([*packed, *pair], reverse=True)
            gap += smallest - sum(pair)
        uses = Counter(packed)
        more = min(left.count[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left.add(n, -k * more)
        out.append((tuple(packed), 1 + more))
    return out


class Places:
    """Where the pieces of each length and rank go, as sorted runs of ranks."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        runs, used, base = [], Counter(), 0
        for lengths, times in bins:
            offset = 0
            for n in lengths:
                runs.append((n, used[n], base, offset))
                used[n] += times
                offset += n
            base += times
        runs.sort()
        length, rank, self.base, self.offset = np.array(runs, np.int64).reshape(-1, 4).T.copy()
        self.rank = rank
        self.key = (length << 48) | rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        return self.base[at] + rank - self.rank[at], self.offset[at]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length up to the capacity.

    `found` must give the same rows whenever it is read: a table, not a computation. Every piece is
    packed. Which of several pieces with the same length goes where follows from a hash of its id.
    """
    spark = found.sparkSession
    total = found.count()
    buckets = max(RANK_BUCKETS, total // BUCKET_ROWS)
    keys = ["length", "_bucket"]
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32")
    ranks = dealt.withColumn("_own", F.row_number().over(own) - 1).join(starts, keys).withColumn("_rank", F.col("_own") + F.col("_start"))
    shared = spark.sparkContext.broadcast(places)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = shared.value.of(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return ranks.withColumn("_place", place("length", "_rank")).select(*found.columns, "_place.*")


def best_two_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """All documents as pieces packed into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids, if asked for);
    offsets in a sequence are gapless from 0. Null and empty texts are a piece of `end_id` alone, rows
    with a null id are packed like others, and repeated rows each. An empty table gives no rows. Other
    columns of the documents are not read, so clashing names do not matter.
    """
    return pack(written(pieces(docs, path, capacity, end_id, ids), "pieces"), capacity)
