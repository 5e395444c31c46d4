"""Spelling variants: words that differ in one letter, found by anagram hashing.

A word's anagram key is the sum of a power of each of its letters, so the order of letters does not matter.
Fifth powers have no two equal differences, so how two keys differ tells which letter was added, removed
or exchanged. Instead of trying every such value, each word asks with its key and with its key less each of
its letters: an exchange makes two of the latter equal, an addition or removal one of the latter and a key.

The one letter lies in the first or the second half of what both words keep, so words are asked for with
their other half as it stands; that splits what would be large classes of anagrams. What meets is verified
letter by letter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, written
from millrace.llm.shingles import mixed

#: Code points of a word and its occurrences, at least.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is this many times as frequent as its variant, at least.
TIMES = 10
#: One in so many distinct runs of a document loses a letter.
LOSES = 31
#: The power that a letter's code is raised to.
POWER = 5
#: Distinct words that a task counts before it hands them on, and code points of a text that are split at once.
ENTRIES, SLICE = 400_000, 4 << 20
#: Words up to this length are keyed many at a time, longer ones by so many letters.
SHORT, BLOCK = 64, 1 << 16

NO_LETTER = re.compile(rb"[^a-z\xc0-\xff]")
VALUES = np.arange(256, dtype=np.uint64) ** np.uint64(POWER)
ODD = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> bytes:
    """A text with one byte for each code point, A-Z lower-cased; what is beyond U+00FF is no letter."""
    return text.encode("latin-1", "replace").lower()


def run_counts(data: bytes, least: int = LEAST_LETTERS) -> Counter:
    """How often each run of at least `least` letters occurs; the text is split in parts that end between runs."""
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % max(least, 1))
    total: Counter = Counter()
    at = 0
    while at < len(data):
        gap = NO_LETTER.search(data, at + SLICE)
        end = gap.start() if gap else len(data)
        total.update(run.findall(data, at, end))
        at = end
    return total


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """Per word: n. A run that is drawn by its checksum with the document's id has lost a letter; a null id is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in total], pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = crc32(f"{doc_id}:".encode())
                for word, n in run_counts(letters(text), least_letters).items():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % LOSES == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least_letters:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > ENTRIES:
                    yield rows()
                    total.clear()
        yield rows()

    small_batches(docs.sparkSession)
    read = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return read.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def keys(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What each word asks with: places of words, keys, and whether the first half is as it stands.

    A key mixes the anagram key of what is kept, its length, and the half that stands.
    """
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for size, at in by_length.items():
        step = max(1, (1 << 20) // max(size, 1))
        for k in range(0, len(at), step):
            part = np.array(at[k : k + step])
            chars = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), size)
            yield from _keys(part, chars)


def _summed(chars: np.ndarray, of) -> np.ndarray:
    """Per row, the sum of what `of` gives for a block of columns and its first place; blocks bound the memory for long words."""
    total = np.zeros(len(chars), np.uint64)
    for k in range(0, chars.shape[1], BLOCK):
        total += of(chars[:, k : k + BLOCK], k).sum(1, dtype=np.uint64)
    return total


def _hashed(chars: np.ndarray) -> np.ndarray:
    """A number for each row of letters in their order."""
    weight = lambda k, n: mixed(np.arange(k + 1, k + n + 1, dtype=np.uint64) * ODD)
    return mixed(_summed(chars, lambda part, k: mixed(part.astype(np.uint64) + np.uint64(1)) * weight(k, part.shape[1])))


def _keys(at: np.ndarray, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    size = chars.shape[1]
    total = _summed(chars, lambda part, _: VALUES[part])

    def key(anagram: np.ndarray, half: np.ndarray, length: int, first: bool) -> np.ndarray:
        salt = np.uint64(length * int(ODD) & 0xFFFFFFFFFFFFFFFF)
        return mixed(mixed(anagram + salt) + half + np.uint64(first))

    h = size // 2
    yield at, key(total, _hashed(chars[:, :h]), size, True), np.ones(len(at), bool)
    yield at, key(total, _hashed(chars[:, h:]), size, False), np.zeros(len(at), bool)
    kept = size - 1
    h = kept // 2
    for first, places, half in ((True, range(h, size), _hashed(chars[:, :h])), (False, range(h), _hashed(chars[:, h + 1 :]))):
        if size <= SHORT:
            for p in places:  # a letter that comes twice asks once
                new = ~(chars[:, places.start : p] == chars[:, p : p + 1]).any(1)
                yield at[new], key(total[new] - VALUES[chars[new, p]], half[new], kept, first), np.full(int(new.sum()), first)
        else:
            for row, i in enumerate(at):
                once = VALUES[np.unique(chars[row, places.start : places.stop])]
                yield np.full(len(once), i), key(total[row] - once, np.full(len(once), half[row]), kept, first), np.full(len(once), first)


def asked(words: DataFrame) -> DataFrame:
    """Per word (word, n) and key: key, first (the first half is as it stands), word, n."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(keys([w.encode("latin-1") for w in batch.column(0).to_pylist()]))
            if found:
                at, key, first = (np.concatenate(x) for x in zip(*found, strict=True))
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(first), *rows.columns], ["key", "first", "word", "n"])

    return words.select("word", "n").mapInArrow(ask, "key bigint, first boolean, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (word, n) that one inserted, deleted or replaced letter sets apart, once each: a, n_a, b, n_b with a < b.

    A pair can meet by the first half and by the second; it counts where its first difference says. Sides are
    sorted by hint: Spark would take the size of the words' compressed files for that of all they ask with,
    and send it through the driver.
    """
    rows = asked(words)
    a = rows.select("key", "first", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select("key", "first", F.col("word").alias("b"), F.col("n").alias("n_b"))
    la, lb = F.length("a"), F.length("b")
    half = (F.when(la == lb, la - 1).otherwise(F.least(la, lb)) / 2).cast("int")
    same: Column = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    met = a.join(b.hint("merge"), ["key", "first"]).filter((F.col("a") < F.col("b")) & (F.abs(la - lb) <= 1) & (same == F.col("first")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """Per word of the documents: word, form, root, n, n_near, form_n.

    A word's form is the most frequent word near it, of equals the first in code-point order, if it is
    `times` as frequent; root is where following forms ends, the word itself if it has none.

    Null and empty texts have no words. Repeated rows count each; a null id is an empty one. A table
    without words gives no rows; other columns are not read, so clashing names do not matter.
    """
    words = written(word_counts(docs, least_letters).filter(F.col("n") >= least_count), "words")
    pairs = near_pairs(words)
    way = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("w")).alias("to")), F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("w")).alias("to"))))
    near = pairs.select(way.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("to").alias("to"))
    often = -F.col("to.n") >= times * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(often, F.col("to.w")).alias("form"), F.when(often, -F.col("to.n")).alias("form_n"))
    formed = written(formed, "forms")
    discard(words)
    roots = _roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """Per word with a form: root. Ways are doubled; a form is more frequent by a factor, so they are as long as a logarithm.

    Compressed files say too little of how large their rows are, so these joins are sorted by hint, too.
    """
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = written(ends.join(on.hint("merge"), F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        more = not moved.filter("moved").isEmpty()
        discard(ends)
        ends = moved
        if not more:
            return ends.select("word", "root")
