"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams, most frequent first. A
document gets a profile of its own from its whole text, and the language whose profile is nearest by
the out-of-place distance wins: the sum, over the document's n-grams, of how far each is from its
place in the language's profile, or the profile's length where it is missing.

Letters are lower-cased, and each is a symbol of its own (beyond code point 32749 some share one);
anything else is a word boundary. N-grams of 1 to 4 symbols fit a 64-bit integer, and a document's
ranking is one sort of such integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, held_out, learnable, small_batches, unit_hash

#: N-grams of a profile.
PROFILE = 400
#: Documents that a language's profile is learned from, about: those with the smallest hashes.
TRAIN_DOCS = 2000
#: Languages that are learned at most: the most frequent ones.
LANGS = 256
#: Symbols of an n-gram at most, the bits of a symbol, and the prime below 2^15 that code points are taken modulo.
LONGEST, BITS, SYMBOLS = 4, 15, 32749
#: Characters that are counted at once, and where a text may be cut: at what is no letter and doesn't bear on how letters next to it are lower-cased.
SLICE, CUT = 1 << 20, re.compile("[\\s()\\[\\]{},;!?/\"<>=+*&%$#@|~\\u3000-\\u3003\\u3008-\\u3011\\uff01\\uff0c\\uff1f-]")
#: How fast a share falls with the distance, which is 0 to 1.
TEMPERATURE = 0.02


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point to symbol; 0 for what isn't a letter."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
    return np.where(letter, 1 + points % SYMBOLS, 0).astype(np.uint16)


def grams(text: str) -> np.ndarray:
    """The n-grams of a text, in no order. The upper bits say how many symbols an n-gram has."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[0], symbols()[points], [0]]).astype(np.uint64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    found = [s[s != 0] | np.uint64(1 << BITS * LONGEST)]
    packed = s
    for n in range(2, LONGEST + 1):
        packed = (packed[:-1] << np.uint64(BITS)) | s[n - 1 :]
        inside = np.ones(len(packed), bool)
        for k in range(1, n - 1):
            inside &= s[k : len(s) - n + 1 + k] != 0
        found.append(packed[inside] | np.uint64(n << BITS * LONGEST))
    return np.concatenate(found)


def counted(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and how often each occurs."""
    every = np.sort(every)
    if not len(every):
        return every, every.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two counts of n-grams as one."""
    every, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([a[1], b[1]]), len(every)).astype(np.int64)


def counts_of(text: str, size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and how often each occurs.

    A long text is counted in slices that end before white space or punctuation, where no n-gram goes on; so
    memory is that of a slice and of what is distinct.
    """
    if len(text) <= 2 * size:
        return counted(grams(text))
    total, at = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
    while at < len(text):
        gap = CUT.search(text, at + size)
        end = gap.start() if gap else len(text)
        total = added(total, counted(grams(text[at:end])))
        at = end
    return total


def ranked(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent of ascending n-grams, most frequent first; ties go to the smaller n-gram."""
    if not len(ids):
        return ids
    most = int(counts.max())
    return ids[np.argsort((most - counts).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")[:size]]


class Profiles:
    """Learned profiles, by language in alphabetical order."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.langs = sorted(by_lang)
        self.size = size
        self.ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *by_lang.values()]))
        self.place = np.full((len(self.ids), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.ids, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each profile, from 0 to 1; None for a text without letters."""
        top = ranked(*counts_of(text), self.size)
        if not len(top):
            return None
        if not len(self.ids):
            return np.ones(len(self.langs))
        at = np.minimum(np.searchsorted(self.ids, top), len(self.ids) - 1)
        place = np.where((self.ids[at] == top)[:, None], self.place[at], -1)
        away = np.where(place >= 0, np.abs(place - np.arange(len(top))[:, None]), self.size)
        return np.minimum(away, self.size).sum(0) / (len(top) * self.size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its share of 1 among all; ties go to the first by name."""
        d = self.distances(text) if text else None
        if d is None or not len(d):
            return "und", 0.0
        share = np.exp((d.min() - d) / TEMPERATURE)
        best = int(d.argmin())
        return self.langs[best], float(share[best] / share.sum())


def learn(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS, size: int = PROFILE, langs: int = LANGS) -> Profiles:
    """Profiles from the learnable documents with a language, for the `langs` most frequent languages.

    At most about `train_docs` documents of a language are used, whole: those whose id hashes below
    the share that gives so many. These are dealt by language, and one task counts a language's
    n-grams, so a profile doesn't depend on where rows lie; the driver gets the profiles.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(learnable("doc_id") & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()}
    if not counts:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, min(1.0, train_docs / n))])
    sample = known.filter(F.col("text").isNotNull() & (unit_hash("doc_id") < F.element_at(share, F.col("lang"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            new: dict[str, list] = {}
            for lang_, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if len(t) > SLICE:
                    total[lang_] = added(total[lang_], counts_of(t)) if lang_ in total else counts_of(t)
                else:
                    new.setdefault(lang_, []).append(grams(t))
            for lang_, found in new.items():
                own = counted(np.concatenate(found))
                total[lang_] = added(total[lang_], own) if lang_ in total else own
        profiles = [ranked(ids, n, size).view(np.int64) for ids, n in total.values()]
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "ids": pa.array(profiles, pa.list_(pa.int64()))})

    small_batches(spark)
    rows = sample.select("lang", "text").repartition("lang").mapInArrow(count, "lang string, ids array<bigint>").collect()
    return Profiles({r["lang"]: np.array(r["ids"], np.int64).view(np.uint64) for r in rows if r["ids"]}, size)


def predicted(text: Column, profiles: Profiles) -> Column:
    """lang_pred and score of each text, in a struct."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [profiles.predict(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Without profiles, they are learned from the documents themselves. A null text, one without a
    letter, or any text when no language could be learned is `und` with score 0. Repeated rows are
    predicted each; other columns are not read, so clashing names do not matter.
    """
    small_batches(docs.sparkSession)
    profiles = profiles or learn(docs)
    return docs.select("doc_id", held_out().alias("held_out"), predicted(F.col("text"), profiles).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def kept(docs: DataFrame, profiles: Profiles | None = None, least: float = 0.3) -> DataFrame:
    """The documents in a known language, with their own columns.

    Rejected are `und` and texts whose best language has a share below `least`, barely more than
    chance among four languages: no language stands out. So null and empty texts go, and all texts if
    no language could be learned; repeated rows are judged each, an empty table gives no rows, and
    columns of any name are passed through.
    """
    small_batches(docs.sparkSession)
    profiles = profiles or learn(docs)
    p = fresh(docs, "_lang")
    return docs.withColumn(p, predicted(F.col("text"), profiles)).filter((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= least)).drop(p)
