"""Overlap rounds against going one by one."""

import random

import pytest

from millrace.operators import ranges


def plain(edits):
    own, used, taken = {}, {}, set()
    for s, f, a, b in edits:
        own.setdefault(s, []).append((f, a, b))
    for s in sorted(own):
        if not any(ranges.overlaps(x, y, a, b) for f, a, b in own[s] for x, y in used.get(f, [])):
            taken.add(s)
            for f, a, b in own[s]:
                used.setdefault(f, []).append((a, b))
    return sorted(e for e in edits if e[0] in taken)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    edits = []
    for s in range(120):
        for _ in range(rng.randint(1, 3)):
            a = rng.randint(0, 60 if seed % 2 else 600)
            edits.append((s, f"f{rng.randint(0, 2)}", a, a + rng.choice([0, 0, 1, 2, 5, 40])))
    edits += edits[:3]
    rng.shuffle(edits)
    df = spark.createDataFrame(edits, "suggestion long, file string, start long, end long").repartition(3)
    found = sorted(map(tuple, ranges.disjoint_suggestions(df, few=5).collect()))
    assert found == plain(edits)
    assert sorted(map(tuple, ranges.disjoint_suggestions(df).collect())) == found


def test_hot_place_and_chain(spark):
    """Thousands of ranges over one place take no pairs, and ranges that overlap in a row are taken every other."""
    hot = [(s, "f", 100 - s % 50, 101 + s % 70) for s in range(3000)]
    df = spark.createDataFrame(hot, "suggestion long, file string, start long, end long")
    assert sorted(map(tuple, ranges.disjoint_suggestions(df, few=10).collect())) == plain(hot)
    chain = [(s, "f", s, s + 2) for s in range(21)]
    df = spark.createDataFrame(chain, "suggestion long, file string, start long, end long")
    assert [r["suggestion"] for r in ranges.disjoint_suggestions(df, few=4).orderBy("suggestion").collect()] == list(range(0, 21, 2))


def test_odd_edits(spark):
    schema = "suggestion long, file string, start long, end long, key string"
    rows = [(1, "a", 2, 2, "x"), (2, "a", 2, 2, None), (3, "a", 0, 2, "x"), (4, "a", 1, 3, "x"), (5, None, 0, 1, "x"), (6, "a", 9, 8, "x"), (7, "a", None, 8, "x"), (None, "a", 50, 51, "x"), (8, "a", 0, 0, "x"), (9, "b", 0, 0, "x"), (9, "b", 0, 4, "x")]
    found = ranges.disjoint_suggestions(spark.createDataFrame(rows, schema), few=0).orderBy("suggestion", "end").collect()
    # 3 ends where 1 and 2 insert; 4 holds the insertions; 8 inserts at the start of 3, which came first; 9 is its own affair
    assert [(r["suggestion"], r["end"]) for r in found] == [(1, 2), (2, 2), (3, 2), (9, 0), (9, 4)]
    assert ranges.disjoint_suggestions(spark.createDataFrame([], schema)).count() == 0
