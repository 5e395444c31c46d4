"""Operators whose result depends on order, against the rule followed step by step."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import bins, graph, sequence
from millrace.sources import tree
from millrace.streaming import progress


@pytest.mark.parametrize("seed", range(4))
def test_queue_order_equals_the_queue(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{k}" for k in r.sample(range(100), 30)]
    edges = [(r.choice(nodes), r.choice([*nodes, "elsewhere"])) for _ in range(25 + 15 * seed)]
    df = graph.queue_order(spark.createDataFrame([(n, k) for k, n in enumerate(nodes)], "path string, ord int"), spark.createDataFrame(edges, "src string, dst string"))
    found = sorted(df.collect(), key=lambda v: v["place"])
    assert [v["place"] for v in found] == list(range(30))
    # what one node frees enters by ord, as importers are listed in that order
    place = {n: k for k, n in enumerate(nodes)}
    ordered = sorted({e for e in edges if e[0] != e[1]}, key=lambda e: place.get(e[0], -1))
    assert [v["path"] for v in found] == graph.first_in_first_out(nodes, ordered)


def chosen(rows):
    used, out = set(), {}
    for name, path, ord_ in sorted(rows, key=lambda v: v[2]):
        segments = [s.lower().replace("-", "_") for s in path.split("/")]
        choices = itertools.chain([name], ("_".join(segments[-n:]) for n in range(2, len(segments) + 1)), (f"{name}_{n}" for n in itertools.count(2)))
        out[ord_] = next(c for c in choices if c not in used)
        used.add(out[ord_])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_equal_choosing_in_turn(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["u", "v", "u_2", "u_3", "b_u", "a_b_u", "v_2"]), r.choice(["u", "b/u", "a/b/u", "A/b/u", "a-c/b/u", "v", "b/v"]), k) for k in range(40)]
    rows += [("same", "same", 100 + k) for k in range(30)]
    found = {v["ord"]: v["unique"] for v in graph.unique_names(spark.createDataFrame(rows, "name string, path string, ord int")).collect()}
    assert found == chosen(rows) and len(set(found.values())) == len(rows)


def test_unique_names_never_repeat(spark):
    rows = [("foo", "a/foo", 0), ("foo", "a/foo", 1), ("foo", "a/foo", 2), ("a_foo_2", "q/r", 3), ("foo_2", "x", 4)]
    found = [v["unique"] for v in graph.unique_names(spark.createDataFrame(rows, "name string, path string, ord int")).orderBy("ord").collect()]
    assert found == ["foo", "a_foo", "foo_2", "a_foo_2", "foo_2_2"]


def test_groups_share_a_budget(spark):
    blocks = [("k", "a", 0, "x" * 40), ("k", "a", 1, "x" * 70), ("k", "a", 2, "x"), ("k", "b", 0, "x" * 50), ("k", "b", 1, "x" * 9), ("k", "b", 2, "x" * 8), ("k", "c", 0, "x" * 1), ("m", "a", 0, "x" * 100), ("m", "b", 0, "x" * 99), ("m", "c", 0, "")]
    df = spark.createDataFrame(blocks, "key string, part string, ord int, text string").repartition(3)
    found = {v["key"]: (v["blocks"], v["bytes"]) for v in sequence.budgeted(df, "key", "ord", "text", 100, "skip", "part").collect()}
    # 40, not 70 and so no more of a; 50 joins (91), 9 would reach 100 and ends b; 1 joins
    assert found == {"k": (3, 93), "m": (2, 100)}


def test_comments_are_followed_mark_by_mark(spark):
    r = random.Random(3)
    texts = ["\n".join("".join(r.choices(["/*", "*/", "//", "/", "*", "a", " "], k=r.randint(0, 7))) for _ in range(60)) for _ in range(30)]

    def states(text):
        out, inside = [], False
        for line in text.split("\n"):
            out.append(inside)
            k = 0
            while k < len(line):
                two = line[k : k + 2]
                if inside and two == "*/" or not inside and two == "/*":
                    inside, k = not inside, k + 2
                elif not inside and two == "//":
                    break
                else:
                    k += 1
        return out

    rows = [(d, p, line) for d, t in enumerate(texts) for p, line in enumerate(t.split("\n"))]
    found = {(v["d"], v["pos"]): v["inside"] for v in sequence.in_comment(spark.createDataFrame(rows, "d int, pos int, line string"), "d").collect()}
    assert found == {(d, p): s for d, t in enumerate(texts) for p, s in enumerate(states(t))}


def test_bins_begin_anew_at_each_key(spark):
    rows = [(k % 3, k, (k * 7) % 5 + 1) for k in range(200)] + [(9, 1, 50), (9, 2, 1)]
    found = sorted((v["f"], v["pos"], v["bin"]) for v in bins.greedy_bins(spark.createDataFrame(rows, "f int, pos int, tokens int").repartition(7), "f", 10).collect())
    want = []
    for f in sorted({v[0] for v in rows}):
        bin_ = used = n = 0
        for _, pos, t in sorted(v for v in rows if v[0] == f):
            if n and used + t > 10:
                bin_, used, n = bin_ + 1, 0, 0
            used, n = used + t, n + 1
            want.append((f, pos, bin_))
    assert found == want


def test_joined_texts_are_cut_in_bytes(spark):
    rows = [("a", k, "é" * 5) for k in range(10)] + [("b", 0, None), ("b", 1, "x")]
    found = {v["k"]: v["text"] for v in sequence.joined(spark.createDataFrame(rows, "k string, ord int, text string"), "k", "ord", "text", 25).collect()}
    assert found == {"a": "ééééé\nééééé\né", "b": "\nx"}


def test_reads_hold_parts_of_lines(spark):
    reads = [(1, 0, 'data: {"a"'), (1, 1, ': 1}\n\nda'), (1, 2, "ta:\n: c\ndata:2\nevent: x\ndata: open"), (2, 0, "data: 3\n")]
    found = [(v["run"], v["n"], v["json"]) for v in progress.events_of_reads(spark.createDataFrame(reads, "run int, at int, read string"), "run", "at", "read").orderBy("run", "n").collect()]
    assert found == [(1, 0, '{"a": 1}'), (1, 1, "2"), (2, 0, "3")]


def test_published_digests(spark):
    # test vectors of the 64-bit FNV-1a digest
    known = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    df = spark.createDataFrame([(k,) for k in known], "t string")
    assert {v["t"]: v["d"] for v in df.select("t", sequence.fnv1a("t").alias("d")).collect()} == known


def test_fingerprints_tell_any_change(spark):
    rows = [("p", f"f{k}", f"c{k}") for k in range(50)]
    one = lambda r: tree.fingerprint(spark.createDataFrame(r, "project string, path string, content string")).first()["fingerprint"]
    base = one(rows)
    assert one(rows[::-1]) == base
    assert len({base, one(rows[1:]), one([*rows, rows[0]]), one([("p", "f0", "x"), *rows[1:]]), one([("p", "g0", "c0"), *rows[1:]])}) == 5


@pytest.mark.parametrize("text, value", [("1+2*3", 7.0), ("(1+2)*3", 9.0), ("2^3^2", 512.0), ("-2^2", 4.0), ("2*-3", -6.0), ("2^2.9", 4.0), ("2^-1", 0.5), ("8/4/2", 1.0), ("1/0", None), ("1 2", None), ("(1", None), ("", None), ("1+", None), (")", None), ("0^-1", None)])
def test_arithmetic(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(sequence.arithmetic(F.col("t"))).first()[0] == value
