"""The pruned scan of a tree, what it lists, and stage checkpoints that are replaced as a whole."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.sources import sinks, walk

FILES = {"src/main.py": 9, "src/a b/it's é.py": 3, "src/.hidden/x.py": 4, "node_modules/m/y.js": 5, "lib/util.go": 0, ".git/config": 7, "lib/build/z.go": 2, "docs/big.md": 500_001, "docs/edge.md": 500_000, "README.md": 1, "dist": 4, "deep/a/b/c/d/e.py": 2, "._x": 1}
KEPT = {"src/main.py": 9, "src/a b/it's é.py": 3, "lib/util.go": 0, "docs/edge.md": 500_000, "README.md": 1, "deep/a/b/c/d/e.py": 2}


@pytest.fixture
def root(tmp_path):
    top = tmp_path / ".root of it"  # its own name doesn't matter
    for path, size in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(b"x" * size)
    os.symlink(top / "src", top / "linked")
    os.symlink(top / "README.md", top / "linked.md")
    return str(top)


def test_scan(spark, root):
    for at in (root, f"file://{root}", f"file:{root}/"):
        found = walk.scan(spark, at).collect()
        assert {r["path"]: r["length"] for r in found} == KEPT and len(found) == len(KEPT)
        assert all(len(r["content"]) == r["length"] for r in found)
    names = walk.scan(spark, root, content=False).filter(F.col("path").endswith(".py") & (F.col("length") > 2))
    assert sorted((r["path"], r["content"]) for r in names.collect()) == [("src/a b/it's é.py", None), ("src/main.py", None)]
    assert walk.scan(spark, root + "/nowhere").count() == 0


@pytest.mark.parametrize("tasks", [1, 2, 3, 256])
def test_pruned_folders_are_never_listed(root, tasks, monkeypatch):
    asked, own = [], walk.entries
    monkeypatch.setattr(walk, "entries", lambda system, folder: asked.append(os.path.relpath(folder, root)) or own(system, folder))
    reader = walk.TreeReader(root, tasks, True)
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert {path: n for path, n, _ in rows} == KEPT | {"docs/big.md": 500_001} and len(rows) == len(KEPT) + 1
    assert sorted(asked) == sorted([".", "src", "src/a b", "lib", "docs", "deep", "deep/a", "deep/a/b", "deep/a/b/c", "deep/a/b/c/d"])


def test_conditions_are_taken_over(root, spark):
    from pyspark.sql import datasource as D

    reader = walk.TreeReader(root, 4, True)
    rest = list(reader.pushFilters([D.LessThanOrEqual(("length",), 9), D.StringEndsWith(("path",), ".py"), D.IsNotNull(("path",)), D.EqualTo(("content",), b"x")]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    assert sorted(path for p in reader.partitions() for path, *_ in reader.read(p)) == ["deep/a/b/c/d/e.py", "src/a b/it's é.py", "src/main.py"]


def test_stage_is_replaced_as_a_whole(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda: sorted(r[0] for r in sinks.read_stage(spark, root, "one").collect())
    with pytest.raises(FileNotFoundError):
        rows()
    sinks.write_stage(spark.range(3), root, "one")
    before = sinks.read_stage(spark, root, "one")
    with pytest.raises(PySparkException):
        sinks.write_stage(spark.range(9).select(F.when(F.col("id") > 5, F.raise_error(F.lit("broke off"))).otherwise(1).cast("bigint").alias("id")), root, "one")
    assert rows() == [0, 1, 2] and sinks.stages_done(spark, root, ["one", "two"]) == ["one"]
    sinks.write_stage(spark.range(5), root, "one")
    assert rows() == [0, 1, 2, 3, 4]
    assert before.count() == 3  # who reads the version before can go on
    sinks.write_stage(spark.range(1), root, "one")
    assert rows() == [0] and len([n for _, n, complete in sinks._versions(spark, root, "one") if complete]) == 2


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Both see the same versions before they write; both finish, and one counts for all readers."""
    root, own = str(tmp_path), sinks._versions
    sinks.write_stage(spark.range(2), root, "one")
    seen = own(spark, root, "one")
    monkeypatch.setattr(sinks, "_versions", lambda *a: seen)
    sinks.write_stage(spark.range(3), root, "one")
    sinks.write_stage(spark.range(4), root, "one")
    monkeypatch.setattr(sinks, "_versions", own)
    counts = {sinks.read_stage(spark, root, "one").count() for _ in range(3)}
    assert len(counts) == 1 and counts <= {3, 4}
    sinks.invalidate_from(spark, root, ["one", "two"], "one")
    assert sinks.stages_done(spark, root, ["one"]) == []
