"""Facts about operators on small literal tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import classify as C
from millrace.operators import graph, relate, retrieve, rollup, sequence, verify
from millrace.plans import machine
from millrace.sources import records, sinks, tree
from millrace.streaming import progress


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_headline_of_the_fixture(spark):
    rows = spark.createDataFrame(
        [("alpha", "clean", True, True, 0, None), ("beta", "clean", True, False, 7, None), ("gamma", "impossible", True, False, 300, None), ("delta", "clean", True, None, None, True), ("none", "clean", False, None, None, None)],
        "name string, expectation string, ran boolean, clean boolean, errors bigint, pipeline_failed boolean",
    )
    assert tuple(rollup.headline(rows, "omega").first()) == (1, 3, 7.0, None)
    even = rows.filter("name in ('alpha', 'beta')")
    assert rollup.headline(even, "beta").first()["median_errors"] == 3.5
    assert "| alpha | clean | 0 |" in rollup.markdown(rollup.scoreboard(rows.withColumn("translated", F.lit(1)).withColumn("total", F.lit(2))))


@pytest.mark.parametrize(
    "code, message, family",
    [
        ("E0425", "cannot find", "MissingImport"), ("E0432", "unresolved import", "MissingImport"), ("E0382", "use of moved value", "OwnershipMove"), ("E0308", "mismatched types", "TypeMismatch"),
        ("E0308", "integer too large", "IntegerOverflow"), ("E0277", "`X` cannot be Send", "AsyncMismatch"), ("E0277", "`Display` not implemented", "TraitBoundFailure"), (None, "lifetime may not live", "MissingLifetime"),
        ("E9999", "odd", "Other"), (None, "odd", "Other"), (None, None, "Other"),
    ],
)
def test_families(spark, code, message, family):
    assert spark.createDataFrame([(code, message)], "c string, m string").select(C.family(F.col("c"), F.col("m"))).first()[0] == family


def test_top_k_order(spark):
    queries = spark.createDataFrame([(1, "go", ["a.x", "b.y"]), (2, "go", ["z.z"]), (3, "py", ["a.x"])], "query_id bigint, lang string, symbols array<string>")
    corpus = spark.createDataFrame([(10, "go", ["a.x"], "behavior", False, 5), (11, "go", ["a.x", "b.y"], "compile", False, 5), (12, "go", ["a.x", "b.y"], "behavior", True, 5)], "entry_id bigint, lang string, symbols array<string>, tier string, is_local boolean, source_bytes bigint")
    rows = retrieve.top_k(queries, corpus).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["entry_id"]) for r in rows] == [(1, 12), (1, 11), (1, 10)]


def test_jaccard(spark):
    j = T.jaccard(F.col("a"), F.col("b"))
    assert one(spark, j, a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, j, a=["x"], b=["x"]) == 1
    assert one(spark, j, a=[], b=[]) == 0


def test_api_surface(spark):
    assert one(spark, T.api_surface(F.col("t")), t="ParseFloat(x)") == []
    assert one(spark, T.api_surface(F.col("t")), t="a::b() c.d.e.f A.b x1.y") == ["a.b", "c.d", "e.f", "x1.y"]


def test_first_bytes_keeps_characters_whole(spark):
    for n, want in ((1, ""), (2, "é"), (3, "éa"), (4, "éa"), (5, "éaé"), (9, "éaé")):
        assert one(spark, T.first_bytes(F.col("t"), n), t="éaé") == want


def test_acceptance_tolerance(spark):
    names = [str(k) for k in range(20)]
    for lost, ok in ((0, True), (1, True), (2, True), (3, False), (20, False)):
        assert one(spark, C.acceptable(F.col("a"), F.col("b")), a=names, b=names[lost:]) is ok
    assert one(spark, C.acceptable(F.col("a"), F.col("b")), a=[], b=[]) is True


def edges_of(spark, *pairs):
    edges = spark.createDataFrame(list(pairs) or [("x", "x")], "src string, dst string").filter("true" if pairs else "false")
    nodes = spark.createDataFrame([(n,) for n in sorted({n for p in pairs for n in p} or {"only"})], "path string")
    return {r["path"]: r["level"] for r in graph.levels(nodes, edges).collect()}


def test_levels(spark):
    assert edges_of(spark) == {"only": 0}
    assert edges_of(spark, ("a", "b"), ("b", "c")) == {"c": 0, "b": 1, "a": 2}
    assert edges_of(spark, ("main", "a"), ("main", "b"), ("a", "lib"), ("b", "lib")) == {"lib": 0, "a": 1, "b": 1, "main": 2}
    assert edges_of(spark, ("a", "b"), ("b", "a"), ("c", "a"), ("a", "d")) == {"d": 0, "a": None, "b": None, "c": None}


def test_queue_order():
    assert graph.first_in_first_out(["a", "b", "c"], [("a", "b"), ("b", "c")]) == ["c", "b", "a"]
    assert graph.first_in_first_out(["x", "y", "z"], [("x", "y"), ("y", "x")]) == ["z", "x", "y"]


def compared(spark, **over):
    base = {"spec": "s", "name": "n", "nondeterministic": False, "cmp_stdout": "exact", "cmp_stderr": "exact", "cmp_exit": "exact", "want_stdout": "a", "want_stderr": "", "want_exit": 0, "got_stdout": "a", "got_stderr": "", "got_exit": 0} | over
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'boolean' if k == 'nondeterministic' else 'int' if k.endswith('t_exit') else 'string'}" for k in base))


def test_golden_comparison(spark):
    diffs = lambda **o: verify.differences(compared(spark, **o), [("[0-9]+", "#")]).first()["diffs"]
    assert diffs() == []
    assert diffs(got_stdout="b", got_exit=1) == ["stdout", "exit"]
    assert diffs(got_stdout="b", cmp_stdout="ignore") == []
    assert diffs(want_stdout="t 1  \n", got_stdout="t 2\n", cmp_stdout="normalized") == []
    assert diffs(want_stdout=None, want_exit=None) == ["golden"]
    assert diffs(cmp_exit="normalized", got_exit=3) == ["exit"]


def test_quarantine_alone_is_unverified(spark):
    row = verify.report(verify.differences(compared(spark, nondeterministic=True, got_stdout="b"))).first()
    assert (row["matched"], row["total"], row["quarantined"], row["verdict"]) == (0, 0, 1, "unverified")


def test_duplicates_keep_the_best(spark):
    items = spark.createDataFrame(
        [("m", 1, "fn", "f", None, "todo!()"), ("m", 2, "fn", "f", None, "real"), ("m", 3, "struct", "S", None, "a"), ("m", 4, "enum", "S", None, "longer"), ("m", 5, "fn", "g", "unix", "x"), ("m", 6, "fn", "g", "windows", "x")],
        "module string, pos bigint, kind string, name string, cfg string, src string",
    )
    best = relate.best_items(items)
    assert sorted(r["pos"] for r in best.collect()) == [2, 4, 5, 6]
    assert sorted(r["pos"] for r in relate.best_items(best).collect()) == [2, 4, 5, 6]


def test_definitions_meet_uses_once_however_many_are_alike(spark, monkeypatch):
    """Rows of one name and module are joined as one, with uses in all tasks, and come back as often as they were there."""
    uses = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), ("z", 4), (None, 5)], "use string, n bigint").coalesce(1)
    had = [("a", "m1")] * 700 + [("a", "m2")] + [("a", None)] * 3 + [("b", "m1")] * 2 + [("c", "m1"), (None, "m1")]
    items = spark.createDataFrame(had, "name string, module string")
    sizes, kind = [], type(uses)
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, *a, **b: sizes.append((self.rdd.getNumPartitions(), other.count())) or join(self, other, *a, **b))
    found = relate.defined(uses, items)
    assert found.columns == ["use", "n", "name", "module"]
    want = Counter((u, n, u, m) for u, n in [("a", 1), ("a", 2), ("a", 2), ("b", 3)] for name, m in had if name == u)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert sizes == [(4, 6)]


def test_state_machine(spark):
    log = spark.createDataFrame([(1, k, e) for k, e in enumerate(["StartParsing", "Fail", "ParseComplete", "Reset"])], "run_id bigint, seq int, event string")
    assert tuple(machine.replay(log).first()) == (1, "Idle", 3, 1)


def test_disjoint_ranges_and_edits(spark):
    df = spark.sql("select array(named_struct('start', 0L, 'end', 3L, 'replacement', 'x'), named_struct('start', 5L, 'end', 6L, 'replacement', 'yy')) e")
    assert df.select(sequence.edited(F.lit("abcdefg"), "e")).first()[0] == "xdeyyg"


def test_scan_zip_and_missing_files(spark, tmp_path):
    for name, text in (("src/a.py", "x"), ("node_modules/b.py", "x"), (".git/c", "x"), ("src/big.py", "x" * 500_001)):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    assert [r["path"] for r in tree.scan(spark, str(tmp_path)).collect()] == ["src/a.py"]
    assert records.read_json_lines(spark, str(tmp_path / "none.jsonl"), records.CORPUS, ["file"]).count() == 0


def test_upsert_twice_changes_nothing(spark):
    now = spark.createDataFrame([("a", 0, "1"), ("b", 0, "2")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 1, "3"), ("c", 1, "4")], "k string, seq int, v string")
    once = sinks.upserted(now, new, "k", "seq")
    assert {r["k"]: r["v"] for r in once.collect()} == {"a": "1", "b": "3", "c": "4"} == {r["k"]: r["v"] for r in sinks.upserted(once, new, "k", "seq").collect()}


def test_watched_stream_ends_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"run_id": 1, "seq": 1, "kind": "note", "ts": "2024-01-01T00:00:00"}\n{"run_id": 1, "seq": 2, "kind": "done", "ts": "2024-01-01T00:00:01"}\nbroken\n')
    rows = []
    stream = progress.watched(progress.stream_files(spark, str(tmp_path / "in")))
    progress.run_once(stream, str(tmp_path / "state"), lambda df, n: rows.extend(df.collect()), "append")
    assert [(r["run_id"], r["kind"], r["seq"]) for r in rows] == [(1, "done", 2)]
