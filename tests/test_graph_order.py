"""The queue's order against a plain queue, with cycles, and in few jobs on chains."""

import random

import pytest

from millrace.operators import graph


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "path string, ord long"), spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("seed,whole", [(1, 10**6), (2, 8), (3, 0)])
def test_equals_plain_queue(spark, seed, whole):
    """Small parts in one task, parts with a rest, and parts level by level; cycles and what hangs on them come last."""
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.randint(0, 99) * 1000 + i) for i in range(45)]
    edges = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(45), rng.randrange(45)) for _ in range(40)) if a >= b] + [("n1", "gone"), ("n40", "n41"), ("n41", "n40"), ("n42", "n41"), ("n44", "n43"), ("n44", "n43")]
    found = graph.queue_order(*frames(spark, nodes, edges), whole).orderBy("place").collect()
    names = [p for p, _ in sorted(nodes, key=lambda x: x[1])]
    place = {p: i for i, p in enumerate(names)}
    own = sorted(((a, b) for a, b in edges if a != b and b in place), key=lambda e: place[e[0]])
    assert [r["path"] for r in found] == graph.first_in_first_out(names, own)
    assert [r["place"] for r in found] == list(range(45))
    assert {r["path"] for r in found if r["level"] is None} >= {"n40", "n41", "n42"}


def test_long_chain_in_few_steps(spark, monkeypatch):
    steps = []
    own = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, what: steps.append(what) or own(df, what))
    n = 3000
    nodes = spark.range(n).selectExpr("concat('n', id) AS path", "id * 7919 % 3000 AS ord")
    edges = spark.range(1, n).selectExpr("concat('n', id) AS src", "concat('n', id - 1) AS dst")
    found = graph.queue_order(nodes, edges)
    assert found.filter("level = place and path = concat('n', level)").count() == n
    assert len(steps) < 80


def test_odd_graphs(spark):
    assert graph.queue_order(*frames(spark, [], [])).count() == 0
    found = graph.queue_order(*frames(spark, [("a", 5), ("b", 1), ("b", 3)], [("a", "a"), (None, "a"), ("b", None)])).orderBy("place").collect()
    assert [tuple(r) for r in found] == [("b", 0, 0), ("a", 0, 1)]


def test_what_hangs_on_a_long_chain_does_not_make_it_large(spark, monkeypatch):
    """A chain that fits a task is queued there, however many nodes hang on it."""
    steps = []
    own = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, what: steps.append(what) or own(df, what))
    n, many = 30, 5
    chain = [(f"c{i}", 1000 * i) for i in range(n)]
    hang = [(f"o{i}-{k}", 7919 * (i * many + k) % 1000) for i in range(n) for k in range(many)]
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [(f"o{i}-{k}", f"c{i}") for i in range(n) for k in range(many)] + [("o0-0", "o1-0"), ("o3-1", "c7"), ("o4-1", "x"), ("x", "y"), ("y", "x"), ("o4-2", "o4-1")]
    nodes = [*chain, *hang, ("x", 5), ("y", 6), ("lone", 500)]
    found = graph.queue_order(*frames(spark, nodes, edges), 80).orderBy("place").collect()
    names = [p for p, _ in sorted(nodes, key=lambda x: (x[1], x[0]))]
    place = {p: i for i, p in enumerate(names)}
    assert [r["path"] for r in found] == graph.first_in_first_out(names, sorted(edges, key=lambda e: place[e[0]]))
    assert [r["place"] for r in found] == list(range(len(nodes)))
    assert {r["path"] for r in found if r["level"] is None} == {"x", "y", "o4-1", "o4-2"}
    assert steps.count("ready") == 0
