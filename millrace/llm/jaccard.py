"""Exact self-join of documents by the Jaccard similarity of their word shingles: a grouped prefix join.

Shingles are ordered from rare to frequent, by a sketch of all documents' counts and then by hash.
Documents of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each. The
join runs over groups: documents with the same prefix and size are one group, pairs of groups that
share prefix shingles are filtered by size and by how much the rest can still add, and the pairs that
remain are expanded to their members and verified on whole sets. Members with the same set are one
node throughout, so copies are never paired.

A prefix shingle can be in very many groups, namely those of one large family of near copies. Such
a shingle first proposes each of its groups with one group only, that which has it at the earliest
place and so has least of its own; once verified, these links make most of the family one component,
and what remains to be paired is groups of different components. Nothing is dropped: a pair that is
left out is one whose ends are already known to be in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, written
from millrace.llm.components import components
from millrace.llm.shingles import WORDS, bucket, shingles, sketch

#: Similarity in hundredths from which documents are linked.
PERCENT = 75
#: Documents, by the sketch, from which on a shingle's groups are not gathered in one place.
HOT = 1 << 17
#: Groups that a prefix shingle pairs at once; those of more groups are linked to one of them first.
FAMILY = 24
#: Bits of the table of ids that verification reads texts for; a wrong bit costs time only.
FILTER_BITS = 22
#: Prefixes that a task remembers having emitted.
SEEN = 200_000


def described(docs: DataFrame, counts: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n (size of its set), sig (digest of the set), grp (its prefix and size), prefix,
    and hot, the place in the prefix from which on its shingles are frequent ones.

    A prefix that the task has emitted before comes as null: its group has it already.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(counts)
    bits = int(len(counts)).bit_length() - 1
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = shared.value
        for batch in batches:
            n, sig, grp, prefix, hot = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                if not len(s):
                    grp.append(0)
                    prefix.append(None)
                    hot.append(0)
                    continue
                frequent = table[bucket(s, bits)]
                order = np.argsort(frequent, kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]
                first = s[order]
                hot.append(int(np.searchsorted(frequent[order], HOT, "right")))
                g = group_of(first, len(s))
                grp.append(g)
                if g in seen:
                    prefix.append(None)
                else:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(g)
                    prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(grp, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(hot, pa.int32())],
                ["doc_id", "n", "sig", "grp", "prefix", "hot"],
            )

    return docs.select("doc_id", "text").mapInArrow(describe, f"doc_id {kind}, n int, sig binary, grp bigint, prefix array<bigint>, hot int")


def rests(docs: DataFrame, few: DataFrame, counts: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per node of `few` (grp, node, component): grp, node, component, token, its shingles one of which a
    linked set of the same group must have, too.

    Sets of a group share their prefix. A link needs so many more of the rest in common that, of the
    rest from rare to frequent, they share one among the first.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    bits = int(len(counts)).bit_length() - 1
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, tokens = [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                order = np.argsort(shared.value[bucket(s, bits)], kind="stable")
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                more = max(1, -(-2 * percent * len(s) // (100 + percent)) - p)
                grp.append(group_of(s[order[:p]], len(s)) if p else 0)
                tokens.append(s[order[p : len(s) - more + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grp, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["node", "grp", "tokens"])

    ends = few.select(F.col("node").alias("a"), F.col("node").alias("b"))
    found = among(docs.select(F.col("doc_id").alias("id"), "text"), ends).mapInArrow(firsts, f"node {kind}, grp bigint, tokens array<bigint>")
    return few.join(found, ["grp", "node"]).select("grp", "node", "component", F.explode("tokens").alias("token")).distinct()


def group_of(prefix: np.ndarray, n: int) -> int:
    """The number of the group that sets with this prefix and size are in."""
    return xxhash.xxh3_64_intdigest(prefix.tobytes() + n.to_bytes(8, "little")) - (1 << 63)


def needed(p: str, q: str, percent: int = PERCENT) -> Column:
    """The least overlap of sets of these sizes that makes a link, times 100 + percent."""
    return (F.col(p) + F.col(q)) * percent


def reaches(n: str, pos: str, other: str, percent: int = PERCENT) -> Column:
    """From this place on, a set of n still has the overlap that a link with a set of size `other` needs.

    The first shingle that two linked sets share is at such a place in both.
    """
    return (F.col(n) - F.col(pos)) * (100 + percent) >= needed(n, other, percent)


def postings(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per prefix shingle in two groups or more, and group: token, grp, n, pos, family (groups of the
    shingle), and first (the group that has it at the earliest place).

    Places too late for a link with the smallest group of the shingle are left out. The groups of a
    shingle are gathered by one shuffle, unless it is frequent: what is asked of a frequent one is added
    up before a shuffle and joined to its groups, and such a join can be split.
    """
    own = rows.filter("prefix is not null")
    every = own.select("grp", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("hot"))).alias("pos", "token")).repartition("token").dropDuplicates(["token", "grp"])
    family = Window.partitionBy("token")
    shared = every.withColumn("family", F.count("*").over(family)).filter("family > 1").withColumn("_least", F.min("n").over(family)).withColumn("first", F.min(F.struct("pos", "grp", "n")).over(family))
    hot = own.filter("hot < size(prefix)").select("grp", "n", "hot", F.posexplode(F.slice("prefix", F.col("hot") + 1, F.size("prefix"))).alias("pos", "token")).select("grp", "n", (F.col("pos") + F.col("hot")).alias("pos"), "token")
    hot = written(hot.dropDuplicates(["token", "grp"]), "frequent")
    told = hot.groupBy("token").agg(F.count("*").alias("family"), F.min("n").alias("_least"), F.min(F.struct("pos", "grp", "n")).alias("first")).filter("family > 1")
    shared = shared.unionByName(hot.join(told, "token"))
    return shared.filter((F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("n") + F.greatest(F.col("_least"), F.col("n") * percent / 100)) * percent).drop("_least")


def sizes_allow(a: str, b: str, percent: int = PERCENT) -> Column:
    """The smaller set is large enough for a link with the larger one."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def parities(items: np.ndarray) -> np.ndarray:
    """Of each slot that elements fall into, whether their number is odd; about four slots for an element, 64 to a word."""
    size = 1 << max(6, (4 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(a: str, b: str) -> Column:
    """In how many bits two parities differ; the longer is folded to the shorter, which keeps its meaning.

    Sizes that allow a link make one at most twice as long as the other.
    """
    m = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda c: F.when(F.size(c) > m, F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, m + 1, m), xor)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(xor(x, y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def among(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose id is an end of a pair, and few others: before a shuffle, without one.

    A bit for each slot that an end hashes to is broadcast, 64 to a row, in as many rows at most for any
    number of pairs. The more ends, the more other rows pass; a join follows.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    word, bit = (F.col("_slot") / 64).cast("int"), "shiftleft(1L, cast(_slot % 64 as int))"
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot.alias("_slot"))
    bits = ends.groupBy(word.alias("_word")).agg(F.expr(f"bit_or({bit})").alias("_bits"))
    found = rows.filter("id is not null").withColumn("_slot", slot).join(F.broadcast(bits), word == F.col("_word")).filter(f"_bits & {bit} <> 0")
    return found.select(*rows.columns)


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of node ids whose sets are similar enough, from the whole texts."""
    spark = pairs.sparkSession
    small_batches(spark)
    few = among(docs.select(F.col("doc_id").alias("id"), "text"), pairs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([parities(x) for x in found], pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                ["id", "n", "bits", "items"],
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    known = written(few.mapInArrow(sets, f"id {kind}, n bigint, bits array<bigint>, items array<bigint>"), "sets")
    side = lambda k, *names: known.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in names])
    # sets that differ in d elements have parities that differ in d bits at most
    met = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    met = met.filter((F.col("a_n") + F.col("b_n") - apart("a_bits", "b_bits")) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent * 2)
    likely = written(met.select("a", "b").distinct(), "likely")
    items = among(known.select("id", "items"), likely)
    both = likely.join(items.select(F.col("id").alias("a"), F.col("items").alias("a_items")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("b_items")), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    links = written(both.filter(common * (100 + percent) >= (F.size("a_items") + F.size("b_items")) * percent).select("a", "b").distinct(), "verified")
    discard(known)
    discard(likely)
    return links


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, sig, grp, node) and, of the nodes with a link, their components."""
    counts = sketch(docs, words=words)
    rows = written(described(docs, counts, words, percent), "described")
    nodes = written(rows.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("grp").alias("grp"), F.first("n").alias("n")), "nodes")
    shared = written(postings(rows, percent), "postings")
    members = nodes.select("grp", "node")

    def expanded(groups: DataFrame) -> DataFrame:
        """Pairs of nodes from pairs of groups (x, y)."""
        out = groups.join(members.select(F.col("grp").alias("x"), F.col("node").alias("p")), "x").join(members.select(F.col("grp").alias("y"), F.col("node").alias("q")), "y")
        return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a <> b")

    # groups of several nodes: same prefix and size, sets that differ beyond the prefix
    ends = nodes.groupBy("grp").agg(F.count("*").alias("family"), F.min("node").alias("first"), F.max("node").alias("last")).filter("family > 1")
    several = written(members.join(ends, "grp"), "several")

    # large families: every group with the one that has the shingle earliest, which has least of its own
    over = F.col("family") > FAMILY
    large = shared.filter(over).select("grp", "n", "pos", F.col("first.grp").alias("end"), F.col("first.n").alias("end_n"), F.col("first.pos").alias("end_pos"))
    large = large.filter((F.col("end") != F.col("grp")) & sizes_allow("end_n", "n", percent) & reaches("n", "pos", "end_n", percent) & reaches("end_n", "end_pos", "n", percent)).select(F.least("end", "grp").alias("x"), F.greatest("end", "grp").alias("y")).distinct()
    inside = several.filter(over).select(F.explode(F.array("first", "last")).alias("a"), F.col("node").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(expanded(large).unionByName(inside).distinct(), "pairs")
    links = verified(pairs, docs, words, percent) if not pairs.isEmpty() else pairs
    known = written(components(links), "known")
    if links is not pairs:
        discard(pairs)
    some = not known.isEmpty()

    # all groups of a shingle, unless they are known to be in one component
    at = nodes.join(known, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("component")) if some else nodes.select("grp", "node", F.col("node").alias("component"))
    open_ = shared.select("token", "grp", "n", "pos")
    if some:
        of_group = at.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        open_ = open_.join(of_group, "grp")
    else:
        open_ = open_.withColumn("lo", F.col("grp")).withColumn("hi", F.col("grp"))
    # groups outside the shingle's largest component meet all of the shingle; those inside are settled
    open_ = held = written(open_, "open")
    largest = open_.filter("lo = hi").groupBy("token", "lo").count().groupBy("token").agg(F.min_by("lo", F.struct(-F.col("count"), "lo")).alias("_main"))
    open_ = open_.join(largest, "token", "left").withColumn("main", F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("_main")), F.lit(False))).drop("_main")
    side = lambda k: ["token", *[F.col(c).alias(f"{k}_{c}") for c in ("grp", "n", "pos", "lo", "hi", "main")]]
    apart = (F.col("x_lo") != F.col("x_hi")) | (F.col("y_lo") != F.col("y_hi")) | (F.col("x_lo") != F.col("y_lo"))
    met = open_.filter("not main").select(side("x")).join(open_.select(side("y")), "token")
    met = met.filter((F.col("y_main") | (F.col("x_grp") < F.col("y_grp"))) & (F.col("x_grp") != F.col("y_grp")) & apart & sizes_allow("x_n", "y_n", percent) & reaches("x_n", "x_pos", "y_n", percent) & reaches("y_n", "y_pos", "x_n", percent))
    ordered = F.col("x_grp") < F.col("y_grp")
    pick = lambda c, d: F.when(ordered, F.col(c)).otherwise(F.col(d))
    met = met.select(pick("x_grp", "y_grp").alias("x"), pick("y_grp", "x_grp").alias("y"), pick("x_pos", "y_pos").alias("i"), pick("y_pos", "x_pos").alias("j"), pick("x_n", "y_n").alias("p"), pick("y_n", "x_n").alias("q"))
    met = met.groupBy("x", "y").agg(F.count("*").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("p").alias("p"), F.first("q").alias("q"))
    # up to the last shared shingle the common ones are counted; after it, what remains of the shorter rest
    met = met.filter((F.col("k") + F.least(F.col("p") - F.col("i"), F.col("q") - F.col("j")) - 1) * (100 + percent) >= (F.col("p") + F.col("q")) * percent)
    pairs = expanded(met.select("x", "y"))
    # sets of one group that are still apart meet by what they share of the rest
    within = several.select("grp", "node").join(at.select("node", "component"), "node")
    split = within.groupBy("grp").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("grp")
    few = written(within.join(split, "grp").select("grp", "node", "component"), "apart")
    own = None
    if not few.isEmpty():
        own = written(rests(docs, few, counts, words, percent), "rests")
        other = own.select("grp", "token", F.col("node").alias("b"), F.col("component").alias("d"))
        pairs = pairs.unionByName(own.select("grp", "token", F.col("node").alias("a"), F.col("component").alias("c")).join(other, ["grp", "token"]).filter("a < b and c <> d").select("a", "b"))
    met_pairs = written(pairs.distinct(), "pairs")
    more = None
    if not met_pairs.isEmpty():
        more = verified(met_pairs, docs, words, percent)
        found = written(components(links.unionByName(more)), "components")
        discard(known)
    else:
        found = known
    for t in (shared, several, held, few, own, met_pairs, links, more):
        if t is not None:
            discard(t)
    return rows.select("doc_id", "n", "sig").join(nodes.select("sig", "node"), "sig", "left"), found


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts with the same set of shingles are linked, whatever their order. A null, empty or blank
    text has no shingles and is linked with nothing. Rows with the same id are each placed by their
    own text; a row with a null id has no component unless another row with its set has an id.
    An empty table gives no rows. Other columns are not read, so clashing names do not matter.
    """
    rows, found = linked(docs, words, percent)
    placed = rows.join(found, "node", "left")
    return placed.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with their own columns, of which each group of near duplicates keeps one.

    The one kept is that with the smallest id; of repeated rows with that id, one. Documents without
    an id are kept: nothing says which of a group they would be.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), words, percent)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        return kept.select(docs.columns)
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null")).select(docs.columns)
