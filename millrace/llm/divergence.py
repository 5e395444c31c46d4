"""How far the sources of a language are apart in their terms, by joint count histograms.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased. A language keeps the terms
that enough of its documents have. A source's share of a kept term is smoothed and scaled to an integer, so
all arithmetic is exact and does not depend on the order of sums.

The distance of two sources is a sum over all kept terms of a function of two counts. Most terms share their
counts with many others, so a pair's terms are tallied by (count, count) first, the function is evaluated
once for each cell, and its value is multiplied by the number of terms in the cell. Cells with a zero are
implied: they follow from how many terms of a source have a count, less those that both sources have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, written

#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 30
#: Added to each count, and what shares are scaled by.
ADDED, SCALE = 5, 10**9
#: Ranks of the terms that stand out in a source.
TOP = 50
#: Distinct terms that a task counts before it hands them on, and bytes of a text that are split at once.
ENTRIES, SLICE = 250_000, 4 << 20

TERM, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[\x00-\x60\x7b-\x7f]")


def slices(data: bytes) -> Iterator[bytes]:
    """A lower-cased text in parts that end between terms; only a single term is ever longer than a part."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + SLICE)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """Per (lang, source, term): n, how often it occurs, and docs, in how many documents; null texts and names are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, tuple[Counter, Counter]] = {}
        entries = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, within) in total.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                names = [pa.array([x], pa.string()).take(pa.array([0] * len(n), pa.int32())) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, terms, pa.array(n.values(), pa.int64()), pa.array([within[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, within = total.setdefault((lang, source), (Counter(), Counter()))
                had, seen = len(n), set()
                for part in slices(data.lower()):
                    found = TERM.findall(part)
                    n.update(found)
                    seen.update(found)
                within.update(seen)
                entries += len(n) - had
                if entries > ENTRIES:
                    yield from rows()
                    total.clear()
                    entries = 0
        yield from rows()

    small_batches(docs.sparkSession)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    read = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = read.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """The smoothed share of a count, scaled: one more than the whole part of SCALE * (n + ADDED) / (total + ADDED * terms).

    The product has 38 digits, so counts up to 10^18 are exact.
    """
    wide = lambda c, digits: (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")
    over = wide(wide(n, 20) + ADDED, 27) * F.lit(SCALE).cast("decimal(10,0)")
    under = wide(wide(total, 20) + wide(terms, 18) * F.lit(ADDED).cast("decimal(2,0)"), 38)
    return F.call_function("div", over, under) + 1


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Per group (lang, source): part, item, value, rank.

    Part `pair`: item is each other source of the language, value its distance, all ranks. Part `term`:
    item is each kept term of the source whose share is above the language's, value by how much, ranks to `top`.

    Null texts, languages and sources are empty ones. A group whose documents have no kept term has counts
    of zero; a language that keeps no term has distances of zero. Repeated rows count each; ties are in
    the order of the items' bytes. An empty table gives no rows; other columns are not read.
    """
    every = written(term_counts(docs), "terms")
    kept = written(every.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    counts = written(every.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "term-counts")
    discard(every)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = docs.select(text("lang"), text("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.fillna(0, ["total", "own", "terms", "lang_total"]), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _distances(counts, groups).withColumn("rank", rank)
    terms = _standing_out(counts, groups).withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _standing_out(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each term of a group whose share is above the language's."""
    both = counts.join(groups, ["lang", "source"])
    above = share("n", "total", "terms") - share("lang_n", "lang_total", "terms")
    return both.select("lang", "source", F.col("term").alias("item"), above.alias("value")).filter("value > 0")


def _distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of a language's sources."""
    left = counts.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("n_a"))
    right = counts.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("n_b"))
    joint = written(left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b", "n_a", "n_b").agg(F.count("*").alias("cells")), "joint-counts")

    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), F.col("own").alias("own_a"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.col("own").alias("own_b"))
    pairs = written(one.join(two, "lang").filter("a < b"), "pairs")

    having = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("cells"))
    shared = joint.groupBy("lang", "a", "b", "n_a").agg(F.sum("cells").alias("cells"))
    shared_b = joint.groupBy("lang", "a", "b", "n_b").agg(F.sum("cells").alias("cells"))

    def alone(side: str, both: DataFrame) -> DataFrame:
        """Cells whose other count is zero: all terms with a count on this side, less those that both have."""
        own = having.select("lang", F.col("source").alias(side), F.col("n").alias(f"n_{side}"), "cells")
        all_ = pairs.join(own, ["lang", side]).select("lang", "a", "b", f"n_{side}", "cells")
        less = both.select("lang", "a", "b", f"n_{side}", (-F.col("cells")).alias("cells"))
        return all_.unionByName(less).groupBy("lang", "a", "b", f"n_{side}").agg(F.sum("cells").alias("cells")).filter("cells > 0")

    zero = F.lit(0).cast("bigint")
    cells = joint.unionByName(alone("a", shared).withColumn("n_b", zero)).unionByName(alone("b", shared_b).withColumn("n_a", zero))
    apart = F.abs(share("n_a", "total_a", "terms") - share("n_b", "total_b", "terms"))
    valued = cells.join(pairs, ["lang", "a", "b"]).select("lang", "a", "b", "cells", (apart * F.col("cells")).alias("value"))
    summed = valued.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("cells").alias("seen"))
    # terms that neither source has are the last cell
    nothing = F.abs(share(zero, "total_a", "terms") - share(zero, "total_b", "terms"))
    rest = F.col("terms") - F.coalesce("seen", F.lit(0))
    value = F.when(F.col("terms") == 0, 0).otherwise(F.coalesce("value", F.lit(0)) + rest * nothing)
    found = pairs.join(summed, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("bigint").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.select("lang", way.alias("w"), "value").select("lang", "w.source", "w.item", "value")
