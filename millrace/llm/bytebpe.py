"""Byte-level BPE encoding and decoding with a local rank file, and token counts by distinct pre-token.

Encoding runs the tiktoken library over whole texts. A long text is first cut where no match of the
pre-tokenizer's pattern can reach across, so pieces encode to the same ids as the whole and the
library's regex never holds a text of many megabytes. Its regex can't match white space of a million
characters either; where such a run's match begins and ends is known, so it is given to the library
as the one piece that it is. Decoding goes through raw bytes, so ids that split a character still
come back exactly.

Counting never builds a text's ids. Documents are split into pre-tokens and held in chunks: the
distinct pre-tokens of a chunk by hash bucket, and how often each of its documents has each. The
pre-tokens of a bucket meet in one place, where each distinct one is given to the tokenizers library
once and joined to all chunks that have it; numbers of pieces go back to the chunks, and a document's
tokens are the sum over its frequencies. What is shuffled is each chunk's distinct pre-tokens, packed,
and its frequencies, compressed. Chunks are dealt into slices of about `SLICE`, and buckets of
different slices are apart, so that the chunks of a frequent pre-token never meet in one task; with
more chunks than that, a pre-token is counted once in each slice.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.llm.common import fresh, small_batches, written

#: Characters from which on a text is cut at safe boundaries before it is encoded.
CUT_CHARS = 100_000
#: Characters of white space in a row from which on, in such a text, the run goes to the library by itself.
RUN_CHARS = 10_000
#: Pre-tokens of a chunk, about: a chunk ends with the document that reaches this.
CHUNK_TOKENS = 1 << 19
#: Hash buckets of pre-tokens, and chunks of a slice, about.
BUCKETS, SLICE = 256, 1 << 15

#: White space as Unicode's White_Space property has it, which the libraries' regexes mean by \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A gap between a non-space and a space: no alternative of the pattern matches across it.
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


@lru_cache(maxsize=4)
def runs(least: int) -> re.Pattern:
    """Whole runs of white space of so many characters at least."""
    return re.compile(f"(?<![{SPACE}])[{SPACE}]{{{least},}}")


#: Letters and numbers below U+0250, where Python's re can stand in for \p{L} and \p{N}.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
LATIN_ONLY = re.compile("[^\\x00-\\u024f]")


def safe_pieces(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut only at safe boundaries.

    A text without a safe boundary after `size` characters stays whole.
    """
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    """tiktoken's encoder for a rank file: a line has a token in base 64 and its rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = CUT_CHARS, run: int = RUN_CHARS) -> Iterator[tuple[str, bool]]:
    """The text in parts that encode by themselves, and whether a part is a single match of the pattern.

    The pattern matches a run of white space at the end of a text as a whole, and any other but for
    its last character, which goes with what follows.
    """
    if len(text) <= size:
        yield text, False
        return
    start = 0
    for found in runs(run).finditer(text):
        if start < found.start():
            for piece in safe_pieces(text[start : found.start()], size):
                yield piece, False
        start = found.end() - (found.end() < len(text))
        yield text[found.start() : start], True
    if start < len(text):
        for piece in safe_pieces(text[start:], size):
            yield piece, False


def encode(text: str, path: str, pattern: str) -> list[int]:
    """Ids of one text, special tokens being ordinary text."""
    enc = rank_encoder(path, pattern)
    ids: list[int] = []
    for part, single in parts(text):
        ids += enc._encode_single_piece(part) if single else enc.encode_ordinary(part)
    return ids


def decode_bytes(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes that the ids stand for; they need not be whole characters."""
    return rank_encoder(path, pattern).decode_bytes(ids)


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text as an array; null texts have no ids, as empty ones."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([encode(t or "", path, pattern) for t in batch.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def with_text(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the raw bytes that an array of ids stands for; null arrays give no bytes."""
    small_batches(encoded.sparkSession)

    @F.arrow_udf("binary")
    def raw(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in arrays:
            yield pa.array([decode_bytes(x or [], path, pattern) for x in batch.to_pylist()], pa.binary())

    return encoded.withColumn(out, raw(F.col(ids)))


ROUND_TRIP = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Encode, decode and digest in one pass, so that ids never leave the Python worker.

    Null and empty texts have no tokens and the digests of nothing.
    """

    @F.arrow_udf(ROUND_TRIP)
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            n, of_ids, of_bytes = [], [], []
            for t in batch.to_pylist():
                found = encode(t or "", path, pattern)
                n.append(len(found))
                of_ids.append(hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode_bytes(found, path, pattern)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digests(text)


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    """A tokenizer of the tokenizers library, for one thread, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def piece_model(path: str):
    """A model of the sentencepiece library."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pretokens:
    """Splits texts as a byte-level pre-tokenizer with its own regex does.

    Strings of added tokens inside a text are one token each, as is the library's default. A text
    with characters from U+0250 on is split by the library's own pre-tokenizer.
    """

    def __init__(self, path: str):
        self.tok = json_tokenizer(path)
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.split = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        ).findall

    def of(self, text: str) -> list[str]:
        if not LATIN_ONLY.search(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often a text has each pre-token, and strings of added tokens."""
        if self.added is None or not (found := self.added.split(text))[1:]:
            return Counter(self.of(text)), 0
        total: Counter = Counter()
        for part in found:
            total.update(self.of(part))
        return total, len(found) - 1


@lru_cache(maxsize=2)
def pretokens(path: str) -> Pretokens:
    return Pretokens(path)


@lru_cache(maxsize=4)
def splits_at_bytes(path: str) -> bool:
    """Whether a file is of a tokenizer that Pretokens splits texts for."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    plain = all(not t[k] for t in told.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    kind = told.get("pre_tokenizer") or {}
    return plain and told.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)


#: A byte that no UTF-8 text has.
SEPARATOR = b"\xff"


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def chunks(docs: DataFrame, path: str, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Documents (doc_id, text) by chunk: their ids, bytes and added tokens; the distinct pre-tokens of
    each bucket, packed; and which document has each how often, compressed: per pre-token the number of
    documents that have it, then these documents' places and frequencies."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"chunk bigint, doc_id array<{kind}>, n_bytes array<bigint>, added array<bigint>, pretokens array<binary>, frequencies binary"

    def packed(number: int, doc_id: pa.Array, n_bytes: list[int], added: list[int], found: list[Counter]) -> pa.RecordBatch:
        index = Numbered()
        ids = [np.fromiter(map(index.__getitem__, c), np.int64, len(c)) for c in found]
        times = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in found])
        names = [t.encode() for t in index]
        bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % BUCKETS
        by_bucket = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))
        place_of = np.empty(len(names), np.int64)
        place_of[by_bucket] = np.arange(len(names))
        every, place = place_of[np.concatenate(ids)], np.repeat(np.arange(len(found)), [len(x) for x in ids])
        order = np.argsort(every, kind="stable")
        data = np.concatenate([np.bincount(every, minlength=len(names)), place[order], times[order]]).astype("<u4").tobytes()
        blobs = [SEPARATOR.join([names[k] for k in by_bucket[ends[b] : ends[b + 1]]]) for b in range(BUCKETS)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.ListArray.from_arrays(pa.array([0, len(doc_id)], pa.int32()), doc_id),
                pa.array([n_bytes], pa.list_(pa.int64())),
                pa.array([added], pa.list_(pa.int64())),
                pa.array([blobs], pa.list_(pa.binary())),
                pa.array([len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)], pa.binary()),
            ],
            ["chunk", "doc_id", "n_bytes", "added", "pretokens", "frequencies"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, number, held = pretokens(path), TaskContext.get().partitionId() << 32, 0
        ids, n_bytes, added, found = [], [], [], []
        for batch in batches:
            first = 0
            for at, text in enumerate(batch.column(1).to_pylist()):
                c, extra = split.frequencies(text or "")
                n_bytes.append(len((text or "").encode()))
                added.append(extra)
                found.append(c)
                held += sum(c.values())
                if held >= tokens:
                    ids.append(batch.column(0).slice(first, at + 1 - first))
                    yield packed(number, pa.concat_arrays(ids), n_bytes, added, found)
                    ids, n_bytes, added, found, held = [], [], [], [], 0
                    first, number = at + 1, number + 1
            ids.append(batch.column(0).slice(first))
        if found:
            yield packed(number, pa.concat_arrays(ids), n_bytes, added, found)

    return docs.select("doc_id", "text").mapInArrow(gather, schema)


def piece_numbers(held: DataFrame, path: str) -> DataFrame:
    """Per chunk and bucket: n, the number of pieces of each of its pre-tokens, as 32-bit numbers."""
    slices = max(1, -(-held.count() // SLICE))

    def count(rows: pa.Table) -> pa.Table:
        tok, known = json_tokenizer(path), {}
        lists = [x.as_buffer().to_pybytes().split(SEPARATOR) for chunk in rows.column("blob").chunks for x in chunk]
        new = list(set().union(*lists))
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            known.update(zip(part, map(len, tok.encode_batch_fast([t.decode() for t in part], add_special_tokens=False)), strict=True))
        n = [np.fromiter(map(known.__getitem__, x), "<u4", len(x)).tobytes() for x in lists]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "n": pa.array(n, pa.binary())})

    blobs = held.select("chunk", F.pmod(F.xxhash64("chunk"), F.lit(slices)).alias("slice"), F.posexplode("pretokens").alias("bucket", "blob")).filter(F.length("blob") > 0)
    return blobs.groupBy("slice", "bucket").applyInArrow(count, "chunk bigint, bucket int, n binary")


@F.arrow_udf(ArrayType(LongType()))
def summed(frequencies: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Tokens of each document of a chunk, from frequencies, pieces by bucket, and added tokens."""
    for data, pieces, added in frequencies:
        out = []
        for d, p, a in zip(data, pieces, added, strict=True):
            raw = d.as_buffer()
            numbers = np.frombuffer(pa.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), "zstd"), "<u4").astype(np.int64)
            n = np.frombuffer(b"".join(p.as_py() or []), "<u4").astype(np.int64)
            place, times = np.split(numbers[len(n) :], 2)
            total = a.values.to_numpy(zero_copy_only=False).copy()
            np.add.at(total, place, times * np.repeat(n, numbers[: len(n)]))
            out.append(total)
        yield pa.array(out, pa.list_(pa.int64()))


def piece_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each whole text under a .json or .model file, without special tokens."""
    if path.endswith(".model"):
        return [len(x) for x in piece_model(path).encode(texts, num_threads=1)]
    return [len(x) for x in json_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of each text, counted text by text; null texts count as empty."""

    @F.arrow_udf("bigint")
    def counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(piece_counts([t or "" for t in batch.to_pylist()], path), pa.int64())

    return counts(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, UTF-8 bytes, tokens, and whether there are more than `limit` tokens.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each. Columns other
    than the id and the text are not read, so clashing names do not matter. A tokenizer without a
    byte-level pre-tokenizer has no pre-tokens that could be counted apart; its texts are counted whole.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    over = (F.col("n_tokens") > limit).alias("over_limit")
    if not splits_at_bytes(path):
        whole = own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), n_tokens(F.col("text"), path).alias("n_tokens"))
        return whole.select("*", over)
    held = written(chunks(own, path), "chunks")
    known = written(piece_numbers(held, path), "pieces")
    by_chunk = known.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x.n).alias("pieces"))
    rows = held.select("chunk", "doc_id", "n_bytes", "added", "frequencies").join(by_chunk, "chunk", "left")
    rows = rows.select("doc_id", "n_bytes", summed("frequencies", "pieces", "added").alias("n_tokens"))
    return rows.select(F.explode(F.arrays_zip("doc_id", "n_bytes", "n_tokens")).alias("d")).select("d.*").select("*", over)


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, tokens, and digests of the ids and of the bytes they decode to.

    Null and empty texts have no tokens. Repeated rows are encoded each. Columns other than the id
    and the text are not read, so clashing names do not matter.
    """
    small_batches(docs.sparkSession)
    both = fresh(docs, "_both")
    return docs.select(F.col(doc_id).alias("doc_id"), round_trip(F.col(text), path, pattern).alias(both)).select("doc_id", f"{both}.*")
