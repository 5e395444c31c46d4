"""Two-pass machines over any parts against reading rows one by one."""

import random

import pyarrow as pa
import pytest

from millrace.operators import bins, scan, turns


def parted(rows, names, rng):
    t = pa.table({n: pa.array([r[k] for r in rows]) for k, n in enumerate(names)} | {scan.AT: pa.array(range(len(rows)), pa.int64())})
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randint(0, 6)))})
    return [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def results(machine, parts):
    return [tuple(r.values()) for p in machine.alone(parts) for r in p.to_pylist()]


def keyed(rng, make):
    rows = []
    for k in rng.sample([None, "a", "b", "c", "dd"], rng.randint(1, 4)):
        rows += [(k, *x) for x in make(rng.randint(1, 14))]
    return rows


@pytest.mark.parametrize("seed", range(300))
def test_machines_equal_going_one_by_one(seed):
    rng = random.Random(seed)
    rows = keyed(rng, lambda n: [(i, rng.choice([0, 0, 1, 2, 3, 5, 9, 30])) for i in range(n)])
    budget, want, key = rng.choice([0, 1, 5, 10]), [], object()
    for k, pos, size in rows:
        if k != key:
            key, bin_, used, n = k, 0, 0, 0
        if used + size > budget and n:
            bin_, used, n = bin_ + 1, 0, 0
        used, n = used + size, n + 1
        want.append((k, pos, size, bin_))
    assert results(bins.bin_machine(budget), parted(rows, ("k", "pos", "size"), rng)) == want

    rows = keyed(rng, lambda n: [(b, i, b + rng.choice([-3, 0, 0, 1, 2, 7, 40])) for i, b in enumerate(sorted(rng.randint(0, 30) for _ in range(n)))])
    want, key = [], object()
    for k, begin, order, end in rows:
        if k != key:
            key, busy = k, None
        free = busy is None or begin >= busy
        busy = end if free else busy
        want.append((k, order, free))
    assert results(turns.admit_machine(), parted(rows, ("k", "begin", "order", "end"), rng)) == want

    rows = keyed(rng, lambda n: [(i, rng.choice(["", "da", "ta: x", "data: y\n", "\n", "data:", " z\r\n", "q\ndata: é\nda"])) for i in range(n)])
    want, key = [], object()
    for k, _, text in rows:
        if k != key:
            key, rest, n = k, "", 0
        *lines, rest = (rest + text).split("\n")
        for line in lines:
            data = line.strip()
            if data.startswith("data:") and (data := data.removeprefix("data:").strip()):
                want.append((k, n, data))
                n += 1
    assert results(turns.line_machine(), parted(rows, ("k", "at", "text"), rng)) == want


@pytest.fixture
def many_parts(spark):
    """Sorted tables in several parts, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values_of_a_hot_key(spark, many_parts):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, 1, 2, -5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, x int").repartition(5)
    placed = scan.placed(df, ["k"], ["i"])
    assert placed.select(scan.PART).distinct().count() > 2
    found = {r["i"]: r for r in scan.running(placed, ["k"], total=("sum", F.col("x")), most=("max", F.col("x")), recent=("last", F.col("x"))).collect()}
    state = {}
    for k, i, x in rows:
        total, most, recent = state.get(k, (None, None, None))
        if x is not None:
            total, most, recent = (total or 0) + x, x if most is None else max(most, x), x
        state[k] = total, most, recent
        assert (found[i]["total"], found[i]["most"], found[i]["recent"]) == state[k]
    every = scan.running(scan.placed(df, [], ["i"]), [], n=("sum", F.lit(1)))
    assert sorted((r["i"], r["n"]) for r in every.collect()) == [(i, i + 1) for i in range(400)]


def test_one_gate_for_all_workers(spark, many_parts):
    from millrace.streaming import progress

    rng = random.Random(9)
    rows = [(i, rng.randint(0, 200)) for i in range(120)]
    fires, last = {}, None
    for i, came in sorted(rows, key=lambda r: (r[1], r[0])):
        last = came if last is None else max(came, last + 4)
        fires[i] = last
    found = progress.gated(spark.createDataFrame(rows, "id int, came long"), "came", "id", 4)
    assert {r["id"]: r["fires"] for r in found.collect()} == fires


def test_empty_tables(spark):
    from millrace.streaming import progress

    none = spark.createDataFrame([], "k string, pos long, tokens long")
    assert bins.greedy_bins(none, "k", 5).count() == 0
    assert progress.admitted(none, "k", "pos", "tokens", "pos").count() == 0
    assert progress.gated(none, "pos", "tokens", 5).count() == 0
