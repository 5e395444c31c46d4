"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

The probability of a word after a history is its discounted count's share if the model has seen it there;
else what the discounts of that history left over, dealt out by the next shorter history's model:

    P(w | h) = d(c) c(h w) / c(h)                        if c(h w) > 0
             = left(h) / (1 - S(h)) * P(w | shorter h)   otherwise

where S(h) is the sum of P(w | shorter h) over all w seen after h, so that probabilities add up to one. The
shortest model gives what its discounts left over to one event, any unknown word. A history whose
counts are all too high to be discounted counts one more, and that one is what is left over.

Texts are held in chunks of about CHUNK tokens. An n-gram is the number of its first words, which the next
shorter table gives, and the number of its last word. For each order a chunk asks the n-gram table with its
distinct n-grams and how often its training documents have each. The table is partitioned by history, a
frequent history by its next word too; a partition adds up the counts, stores them, and answers each chunk
with the n-grams' counts and numbers and with each history's discounted counts and S. So no count moves
more than once for each chunk that has the n-gram, and texts never move with a row for each token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import discard, small_batches, written
from millrace.llm.shingles import mixed

#: Words of an n-gram, the last one included.
ORDER = 2
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a chunk, about, and bytes of a text that are split at once.
CHUNK, SLICE = 1 << 21, 4 << 20
#: What chunks ask of a partition of a table, about, and occurrences of a history in a partition, at most.
ASKED, HOT = 1 << 22, 1 << 21
#: The numbers of no n-gram and of the beginning of a text; words have higher ones.
NONE, BEGIN_ID = 0, 1
#: Stand for the beginning and the end of a text; no word has white space.
BEGIN, END = b" ", b"\n"
#: `chunk` of rows that hold a partition's own counts, and of its counts of counts.
MODEL, COUNTS = -1, -2

GAP = re.compile(rb"[\x20\x09-\x0d]")
ODD = 0x9E3779B97F4A7C15
ROWS = "chunk bigint, level int, bucket int, blob binary, counts array<bigint>, ids array<{}>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers or floats, byte by byte of like weight, compressed."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        a = a.view(np.uint64) if a.dtype == np.float64 else a.astype(np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        body.append(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<u8").tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as uint64."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    head = np.frombuffer(data, "<u8", 1 + 2 * n)[1:].reshape(n, 2).astype(int)
    at, out = 8 + 16 * n, []
    for size, width in head:
        planes = np.zeros((size, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        out.append(planes.view("<u8").ravel())
        at += size * width
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """What each number is above the one before."""
    return np.diff(ascending, prepend=np.uint64(0))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes)[sizes > 0]


def steps_within(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each number is above the one before in its group; the first of each group as it is."""
    out, at = steps(values), _starts(sizes)
    out[at] = values[at]
    return out


def sums_within(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of steps_within()."""
    total, at = np.cumsum(found, dtype=np.uint64), _starts(sizes)
    return total - np.repeat(total[at] - found[at], sizes[sizes > 0])


class Places(dict):
    """Places of words in a chunk, in the order they come first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass(frozen=True)
class Discounts:
    """Shares that counts 1, 2, ... keep, and of one order: all counts, and distinct n-grams by count (0: all)."""

    keeps: tuple[float, ...]
    total: int
    having: tuple[int, ...]

    def taken(self, having: np.ndarray | tuple[int, ...]) -> np.ndarray:
        """What the discounts take from n-grams of which so many have each count (0: all)."""
        if not self.keeps:
            return 0.5 * np.asarray(having[0], float)
        return sum(((1 - d) * r * np.asarray(having[r], float) for r, d in enumerate(self.keeps, 1)), np.zeros(np.shape(having[0])))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = counts.astype(np.float64)
        if not self.keeps:
            return np.maximum(c - 0.5, 0)
        keep = np.array([1.0, *self.keeps])
        return c * np.where(counts < len(keep), keep[np.minimum(counts, len(keep) - 1).astype(int)], 1.0)


def good_turing(total: int, having: tuple[int, ...]) -> Discounts:
    """Discounts of an order from how many distinct n-grams (0: all) have each count up to DISCOUNTED + 1.

    Counts up to k keep ((r+1) n[r+1] / (r n[r]) - x) / (1 - x) of themselves, x = (k+1) n[k+1] / n[1]: what is
    taken is what n-grams seen once have, as Good and Turing say, and counts above k keep all. k is
    DISCOUNTED, or the highest below it for which every share lies between 0 and 1; where there is none,
    as in very small tables, every count gives away one half.
    """
    n = having
    for k in range(DISCOUNTED, 1, -1):
        if not all(n[1 : k + 2]) or (x := (k + 1) * n[k + 1] / n[1]) >= 1:
            continue
        keeps = tuple(((r + 1) * n[r + 1] / (r * n[r]) - x) / (1 - x) for r in range(1, k + 1))
        if all(0 < d < 1 for d in keeps):
            return Discounts(keeps, total, n)
    return Discounts((), total, n)


def chunked(docs: DataFrame, order: int, learns: Column, held: Column, doc_id: str, text: str) -> DataFrame:
    """Chunks of the documents' tokens, level 0; a document that doesn't fit goes on in the next chunk, after its last words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        made = rows = size = 0
        schema = None

        def start() -> tuple[Places, list, list, list]:
            return Places({BEGIN: 0, END: 1}), [], [], []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, places), np.uint64, len(places))
            often = np.lexsort((words, -np.bincount(tokens, minlength=len(places))))  # frequent words get small numbers
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            blob = pack(rank[tokens], steps(words[often]), *np.array(pieces, np.uint64).T)
            ids = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.concat_arrays(names))
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary()), pa.array([None], pa.list_(pa.int64())), ids], schema=schema)

        places, parts, pieces, names = start()
        for batch in batches:
            schema = schema or pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("counts", pa.list_(pa.int64())), ("ids", pa.list_(batch.column(0).type))])
            for i, (learn, out, data) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                key, rows, data, at = base + rows, rows + 1, data.lower(), 0
                before, found, ended = [BEGIN], [], False
                while not ended:
                    gap = GAP.search(data, at + SLICE)
                    ended = gap is None
                    words = data[at : gap.start() if gap else len(data)].split()
                    at = gap.start() if gap else len(data)
                    words += [END] * ended
                    first = not found
                    found.append(np.fromiter(map(places.__getitem__, before + words if first else words), np.uint32, len(words) + (len(before) if first else 0)))
                    size += len(found[-1])
                    context = len(before) if first else context
                    last = (last + words if not first else before + words)[-(order - 1) :] if order > 1 else []
                    if ended or size >= CHUNK:
                        if any(map(len, found)):
                            parts += found
                            pieces.append((sum(map(len, found)), context, learn, out, key))
                            names.append(batch.column(0).slice(i, 1))
                        before, found = last, []
                    if size >= CHUNK:
                        yield flush()
                        made, size = made + 1, 0
                        places, parts, pieces, names = start()
        if parts:
            yield flush()

    small_batches(docs.sparkSession)
    flag = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    read = docs.select(F.col(doc_id).alias("id"), flag(learns, "learns"), flag(held, "held"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(build, ROWS.format(kind))


class Chunk:
    """A chunk's tokens with what the tables have answered so far."""

    def __init__(self, blob: bytes):
        tok, words, size, context, learn, held, self.key = unpack(blob)
        self.tok, self.words, size = tok.astype(np.int64), np.cumsum(words, dtype=np.uint64), size.astype(int)
        self.starts = np.cumsum(size) - size
        self.held = held.astype(bool)
        self.place = np.arange(len(tok)) - np.repeat(self.starts, size)
        self.scored = self.place >= np.repeat(context.astype(int), size)
        self.counted = self.scored & np.repeat(learn.astype(bool), size)
        self.begin = int(np.flatnonzero(self.words == xxhash.xxh3_64_intdigest(BEGIN))[0])
        self.end = int(np.flatnonzero(self.words == xxhash.xxh3_64_intdigest(END))[0])
        self.level, self.at = 0, None

    def ask_words(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """What the chunk asks of the table of words, by partition."""
        n = np.bincount(self.tok[self.counted], minlength=len(self.words))
        for bucket, at in self._words(buckets):
            yield bucket, pack(steps(self.words[at]), n[at])

    def _words(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (mixed(self.words) % np.uint64(buckets)).astype(int)
        bucket[self.begin] = buckets
        order = np.lexsort((self.words, bucket))[:-1]
        yield from zip(*_parts(bucket[order], order), strict=True)

    def answer_words(self, answers: dict[int, bytes], buckets: int, discounts: Discounts) -> None:
        """Take counts and numbers of words; self.p becomes the probability of each token by itself."""
        self.n, self.id = np.zeros(len(self.words), np.uint64), np.zeros(len(self.words), np.uint64)
        for bucket, at in self._words(buckets):
            self.n[at], self.id[at] = unpack(answers[bucket])
        left = float(discounts.taken(discounts.having)) / discounts.total if discounts.total else 1.0
        p = np.where(self.n > 0, discounts(self.n) / max(discounts.total, 1), left)
        self.word_n, self.word_id = self.n, self.id
        self.n, self.id = self.n.copy(), self.id.copy()
        self.n[self.begin], self.id[self.begin] = self.n[self.end], BEGIN_ID
        self.gram, self.gram_p, self.p, self.level = self.tok, p, p[self.tok], 1

    def _extend(self) -> None:
        """The distinct n-grams that are one word longer than those of this level."""
        if self.at is not None:
            return
        self.at = np.flatnonzero(self.place >= self.level)
        both = self.gram[self.at - 1] * len(self.words) + self.tok[self.at]
        distinct, first, self.of = np.unique(both, return_index=True, return_inverse=True)
        self.before, self.word = distinct // len(self.words), distinct % len(self.words)
        self.lower = self.gram_p[self.gram[self.at[first]]]

    def _units(self, buckets: int):
        """Partitions of histories and of the n-grams that can be in the table, in the order that both sides use."""
        known = self.id[self.before] > 0
        history = np.unique(self.before[known])
        split = (self.n[history] // np.uint64(HOT)).astype(int) + 1
        start = np.cumsum(split) - split
        unit_history = np.repeat(np.arange(len(history)), split)
        part = np.arange(len(unit_history)) - start[unit_history]
        ids = self.id[history[unit_history]]
        bucket = (mixed(mixed(ids) + part.astype(np.uint64)) % np.uint64(buckets)).astype(int)
        unit_order = np.lexsort((part, ids, bucket))
        rank = np.empty(len(unit_order), int)
        rank[unit_order] = np.arange(len(unit_order))
        asked = np.flatnonzero(known & (self.word_id[self.word] > 0))
        place = np.searchsorted(history, self.before[asked])
        words = self.word_id[self.word[asked]]
        unit = rank[start[place] + (mixed(words) % split[place].astype(np.uint64)).astype(int)]
        order = np.lexsort((words, unit))
        return history, unit_history[unit_order], part[unit_order], ids[unit_order], bucket[unit_order], asked[order], unit[order], words[order]

    def ask(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """What the chunk asks of the next table, by partition: histories, their n-grams, how often, and what shorter histories say."""
        self._extend()
        _, _, part, ids, bucket, asked, unit, words = self._units(buckets)
        n = np.bincount(self.of, self.counted[self.at], len(self.before)).astype(np.uint64)[asked]
        lower = self.lower[asked]
        sizes = np.bincount(unit, minlength=len(ids))
        ends = np.cumsum(sizes)
        for b, at in zip(*_parts(bucket, np.arange(len(bucket))), strict=True):
            own = slice(ends[at[0]] - sizes[at[0]], ends[at[-1]])
            yield b, pack(steps(ids[at]), part[at], sizes[at], steps_within(words[own], sizes[at]), n[own], *_shorter(self.level + 1, words[own], lower[own], n[own]))

    def answer(self, answers: dict[int, bytes], buckets: int, discounts: Discounts, numbered: bool) -> None:
        """Take counts, numbers and histories' sums; self.p becomes the probability of each token after one word more."""
        self._extend()
        history, unit_history, _, _, bucket, asked, unit, _ = self._units(buckets)
        n, id_ = np.zeros(len(self.before), np.uint64), np.zeros(len(self.before), np.uint64)
        having, seen = np.zeros((DISCOUNTED + 1, len(history))), np.zeros(len(history))
        sizes = np.bincount(unit, minlength=len(bucket))
        ends = np.cumsum(sizes)
        for b, at in zip(*_parts(bucket, np.arange(len(bucket))), strict=True):
            own = asked[ends[at[0]] - sizes[at[0]] : ends[at[-1]]]
            n[own], numbered_, *sums, which, values = unpack(answers[b])
            if numbered:
                id_[own] = numbered_
            np.add.at(seen, unit_history[at], values.view(np.float64)[which.astype(int)])
            for r, s in enumerate(sums):
                np.add.at(having[r], unit_history[at], s)
        taken, total = discounts.taken(having), self.n[history].astype(np.float64)
        total += taken == 0
        left = np.where(taken == 0, 1.0, taken) / total / (1 - seen)
        place = np.minimum(np.searchsorted(history, self.before), max(len(history) - 1, 0))
        known = self.id[self.before] > 0
        p = self.lower.copy()
        at = place[known]
        p[known] = np.where(n[known] > 0, discounts(n[known]) / total[at], left[at] * self.lower[known])
        self.p[self.at] = p[self.of]
        gram = np.full(len(self.tok), -1)
        gram[self.at] = self.of
        self.gram, self.gram_p, self.n, self.id, self.level, self.at = gram, p, n, id_, self.level + 1, None

    def scores(self, words: Discounts) -> list[np.ndarray]:
        """Per piece: key, held, tokens, known tokens, base score, score."""
        n = self.word_n[self.tok].astype(np.float64)
        ends = [*self.starts[1:], len(self.tok)]
        add = lambda x: np.array([y.sum() for y in map(np.where(self.scored, x, 0).__getitem__, map(slice, self.starts, ends))])
        base = np.log10((n + 0.5) / (words.total + 0.5 * (words.having[0] + 1)))
        return [self.key.view(np.int64), self.held, add(np.int64(1)), add((n > 0).astype(np.int64)), add(base), add(np.log10(self.p))]


def _shorter(level: int, words: np.ndarray, lower: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What shorter histories say, as places in a list of values: of each distinct word if that is all they know, else of each n-gram."""
    if level == 2:
        lower = lower[np.unique(words, return_index=True)[1]]
    else:
        lower = np.where(n > 0, lower, 0.0)
    values, which = np.unique(lower, return_inverse=True)
    return which, values


def _shorter_of(level: int, words: np.ndarray, which: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What shorter histories say of each n-gram."""
    lower = values.view(np.float64)[which.astype(int)]
    return lower[np.unique(words, return_inverse=True)[1]] if level == 2 else lower


def _parts(ascending: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows split by their partition."""
    if not len(rows):
        return [], []
    first = np.flatnonzero(np.diff(ascending, prepend=-1))
    return ascending[first].tolist(), np.split(rows, first[1:])


def _answers(bucket: int, level: int, kind: pa.DataType, own: list[tuple[int, bytes]], model: bytes, counts: list[int]) -> pa.Table:
    chunks = [c for c, _ in own] + [MODEL, COUNTS]
    n = len(chunks)
    blobs = [b for _, b in own] + [model, None]
    return pa.table([pa.array(chunks, pa.int64()), pa.array([level] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(blobs, pa.binary()), pa.array([None] * (n - 1) + [counts], pa.list_(pa.int64())), pa.nulls(n, pa.list_(kind))], names=["chunk", "level", "bucket", "blob", "counts", "ids"])


def _summary(n: np.ndarray) -> list[int]:
    """All counts, distinct n-grams, and how many have each count up to DISCOUNTED + 1."""
    return [int(n.sum()), int((n > 0).sum()), *np.bincount(np.minimum(n, DISCOUNTED + 2).astype(int), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()]


def _numbered(n: np.ndarray, buckets: int, bucket: int) -> np.ndarray:
    """Numbers of n-grams that were seen, unlike those of other partitions; frequent ones get small numbers."""
    rank = np.empty(len(n), np.uint64)
    rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(n))
    return np.where(n > 0, rank * np.uint64(buckets) + np.uint64(bucket + BEGIN_ID + 1), np.uint64(NONE))


def word_table(level: int, buckets: int, kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Adds up a partition of the table of words and answers each chunk."""

    def merge(rows: pa.Table) -> pa.Table:
        bucket, chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
        asked = [unpack(b) for b in rows.column("blob").to_pylist()]
        words, of = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), return_inverse=True)
        n = np.bincount(of, np.concatenate([a[1] for a in asked]).astype(float), len(words)).astype(np.uint64)
        ids, seen = _numbered(n, buckets, bucket), n > 0
        own = np.split(of, np.cumsum([len(a[0]) for a in asked])[:-1])
        return _answers(bucket, level, kind, [(c, pack(n[o], ids[o])) for c, o in zip(chunks, own, strict=True) if c >= 0], pack(steps(words[seen]), n[seen]), _summary(n))

    return merge


def gram_table(level: int, buckets: int, kind: pa.DataType, numbered: bool) -> Callable[[pa.Table], pa.Table]:
    """Adds up a partition of a table of longer n-grams and answers each chunk."""

    def merge(rows: pa.Table) -> pa.Table:
        bucket, chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
        asked = [unpack(b) for b in rows.column("blob").to_pylist()]
        every = lambda k: np.concatenate([a[k] for a in asked])
        history, part, sizes = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), every(1), every(2).astype(int)
        _, first, unit = np.unique((history << np.uint64(20)) + part, return_index=True, return_inverse=True)
        said = [sums_within(a[3], a[2].astype(int)) for a in asked]
        words, word = np.unique(np.concatenate(said), return_inverse=True)
        width = max(len(words), 1)
        grams, of = np.unique(np.repeat(unit, sizes) * width + word, return_inverse=True)
        counts = every(4)
        n = np.bincount(of, counts.astype(float), len(grams)).astype(np.uint64)
        lower = np.zeros(len(grams))
        lower[of[counts > 0]] = np.concatenate([_shorter_of(level, w, a[5], a[6]) for w, a in zip(said, asked, strict=True)])[counts > 0]
        seen, of_unit = n > 0, grams // width
        units = len(first)
        sums = [np.bincount(of_unit[seen if r == 0 else n == r], minlength=units) for r in range(DISCOUNTED + 1)]
        total = np.bincount(of_unit[seen], lower[seen], units)
        ids = _numbered(n, buckets, bucket) if numbered else np.zeros(len(n), np.uint64)
        own, own_units = np.split(of, np.cumsum([len(a[3]) for a in asked])[:-1]), np.split(unit, np.cumsum([len(a[0]) for a in asked])[:-1])
        out = []
        for c, o, u in zip(chunks, own, own_units, strict=True):
            values, which = np.unique(total[u], return_inverse=True)
            if c >= 0:
                out.append((c, pack(n[o], ids[o], *[s[u] for s in sums], which, values)))
        having, known = np.flatnonzero(sums[0]), words[grams[seen] % width]
        sizes = sums[0][having]
        model = pack(steps(history[first][having]), part[first][having], sizes, steps_within(known, sizes), n[seen], *_shorter(level, known, lower[seen], n[seen]))
        return _answers(bucket, level, kind, out, model, _summary(n))

    return merge


def asking(level: int, buckets: list[int], known: list[Discounts], order: int, kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Gives what a chunk, with the answers so far, asks of the next table."""

    def ask(rows: pa.Table) -> pa.Table:
        chunk, c = rows.column("chunk")[0].as_py(), _chunk(rows, buckets, known, order)
        asked = list(c.ask_words(buckets[0]) if level == 1 else c.ask(buckets[level - 1]))
        n = len(asked)
        return pa.table([pa.array([chunk] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array([b for b, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(kind))], names=["chunk", "level", "bucket", "blob", "counts", "ids"])

    return ask


def row_by_row(ask: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For chunks that have no answers yet, a row each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield from ask(pa.Table.from_batches([batch.slice(k, 1)])).to_batches()

    return each


@dataclass
class Model:
    """Tables of n-gram counts by order, partitioned by history, with each order's partitions and discounts."""

    order: int
    tables: list[DataFrame] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)
    discounts: list[Discounts] = field(default_factory=list)

    def delete(self) -> None:
        """Delete the tables."""
        for t in self.tables:
            discard(t)


def model_and_scores(docs: DataFrame, learns: Column | None, held: Column, order: int = ORDER, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """A model of the documents for which `learns`, and per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    With a model of before, documents are scored by it and nothing is learned. The model's tables stay in
    the shared folder until Model.delete().
    """
    learned = model is not None
    chunks = written(chunked(docs, order, F.lit(False) if learned else learns, held, doc_id, text), "lm-chunks")
    kind, arrow = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(docs.schema[doc_id].dataType)
    tokens = chunks.count() * CHUNK
    model = model or Model(order)
    own, tables = [chunks], []
    schema = ROWS.format(kind)
    for level in range(1, order + 1):
        if not learned:
            model.buckets.append(max(16, tokens // (ASKED * (4 if level == 1 else 1))))
        buckets, known = model.buckets[:level], model.discounts[: level - 1]

        ask = asking(level, buckets, known, order, arrow)

        asked = chunks.mapInArrow(row_by_row(ask), schema) if level == 1 else _union(own).groupBy("chunk").applyInArrow(ask, schema)
        if learned:
            asked = asked.unionByName(model.tables[level - 1].filter(F.col("chunk") == MODEL))
        merge = word_table(level, buckets[0], arrow) if level == 1 else gram_table(level, buckets[-1], arrow, level < order)
        table = written(asked.groupBy("bucket").applyInArrow(merge, schema), f"lm-{level}")
        tables.append(table)
        if not learned:
            model.tables.append(table)
            found = table.filter(F.col("chunk") == COUNTS).select(*[F.coalesce(F.sum(F.get("counts", F.lit(k))), F.lit(0)) for k in range(DISCOUNTED + 3)]).first()
            model.discounts.append(good_turing(found[0], tuple(found[1:])))
        own.append(table.filter("chunk >= 0"))

    buckets, known = model.buckets, model.discounts

    def score(rows: pa.Table) -> pa.Table:
        c = _chunk(rows, buckets, known, order)
        ids = pa.concat_arrays([x.flatten() for x in rows.filter(pc.equal(rows.column("level"), 0)).column("ids").chunks])
        return pa.table([ids, *map(pa.array, c.scores(known[0]))], names=["doc_id", "key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pieces = _union(own).groupBy("chunk").applyInArrow(score, f"doc_id {kind}, key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    total = F.lit(known[0].total).cast("bigint").alias("train_tokens")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = pieces.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    scores = written(whole.select("doc_id", "held_out", "n_tokens", "n_known", total, "base_score", "score"), "lm-scores")
    discard(chunks)
    if learned:
        for t in tables:
            discard(t)
    return model, scores


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _chunk(rows: pa.Table, buckets: list[int], known: list[Discounts], order: int) -> Chunk:
    """A chunk with all answers so far, from its rows."""
    answers: dict[int, dict[int, bytes]] = {}
    for level, bucket, blob in zip(*[rows.column(c).to_pylist() for c in ("level", "bucket", "blob")], strict=True):
        answers.setdefault(level, {})[bucket] = blob
    c = Chunk(answers[0][0])
    for level, discounts in enumerate(known, 1):
        if level == 1:
            c.answer_words(answers.get(1, {}), buckets[0], discounts)
        else:
            c.answer(answers.get(level, {}), buckets[level - 1], discounts, level < order)
    return c


def scored(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose id's crc32 modulo 5 is not 1 and scores all: log10 of the
    probability of all words and the end, given that the text begins. base_score is that of single words
    with one half added to each count.

    Null and empty texts have the end as their only token. A document without an id is scored, not held
    out, and nothing is learned from it. Repeated rows are scored and learned from each. If nothing is
    learned, every token has probability 1 of being an unknown one. An empty table gives no rows; other
    columns are not read, so clashing names do not matter.
    """
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    model, scores = model_and_scores(docs, rest != 1, rest == 1, order, doc_id=doc_id, text=text)
    model.delete()
    return scores
