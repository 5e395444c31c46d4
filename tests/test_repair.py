"""The bounded repair loop: kept, taken back, given up, done early, and cut off."""

from pyspark.sql import functions as F

from millrace.operators import repair


def issues(rows):
    return rows.filter("bad > 0").select("project", "item")


def test_kept_reverted_bounded(spark):
    # a: one issue less each cycle; b: gets worse; c: nothing to do; d: as many issues as before; null: no project
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("b", 1, 1), ("c", 1, 0), ("d", 1, 1), ("d", 2, 0), (None, 9, 1)]
    state = spark.createDataFrame(rows, "project string, item int, bad int")
    asked = []

    def mend(own, found):
        asked.append(sorted({r["project"] for r in own.collect()}))
        first = found.groupBy("project").agg(F.min("item").alias("first"))
        both = own.join(first, "project")
        bad = F.when(F.col("item") == F.col("first"), F.when(F.col("project") == "a", 0).otherwise(F.col("bad"))).otherwise(F.col("bad"))
        more = both.filter("project = 'b'").withColumn("item", F.col("item") + 100)
        return both.withColumn("bad", bad).unionByName(more).select("bad", "item", "project")

    left, summary = repair.repaired(state, "project", issues, mend, 3)
    assert sorted((r["project"] or "", r["item"], r["bad"]) for r in left.collect()) == [("", 9, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("b", 1, 1), ("c", 1, 0), ("d", 1, 1), ("d", 2, 0)]
    assert sorted(tuple(r) for r in summary.collect()) == [(1, "a", 4, 3, True), (1, "b", 1, 2, False), (1, "d", 1, 1, False), (2, "a", 3, 2, True), (3, "a", 2, 1, True)]
    assert asked == [["a", "b", "d"], ["a"], ["a"]]


def test_ends_early(spark):
    state = spark.createDataFrame([("a", 1, 1), ("b", 1, 0)], "project string, item int, bad int")
    left, summary = repair.repaired(state, "project", issues, lambda own, found: own.withColumn("bad", F.lit(0)), 50)
    assert left.filter("bad > 0").count() == 0 and [tuple(r) for r in summary.collect()] == [(1, "a", 1, 0, True)]
    none = state.limit(0)
    left, summary = repair.repaired(none, "project", issues, lambda own, found: own, 5)
    assert left.count() == summary.count() == 0 and summary.columns == ["cycle", "project", "before", "after", "kept"]


def test_dependencies_one_at_a_time(spark):
    text = {"a": ["x = 1", "bad1 = 2", " bad2 = 3", "bad1 = 4", "# bad1"], "b": ["y = 1"], "c": ["z = 1"], "d": ["bad2 = 0", "bad3 = 0", "bad4 = 0"]}
    lines = spark.createDataFrame([(f, i, x) for f, own in text.items() for i, x in enumerate(own)], "file string, pos int, line string")

    def log_of(lines):
        # c's log names what is not in its manifest
        bad = lines.filter(F.col("line").rlike("^ ?bad")).withColumn("name", F.trim(F.substring_index("line", "=", 1))).groupBy("file").agg(F.min_by("name", "pos").alias("name"))
        bad = bad.unionByName(lines.filter("file = 'c'").groupBy("file").agg(F.lit("gone").alias("name")))
        return bad.select(F.col("file").alias("run_id"), F.concat(F.lit("error: no matching package named `"), "name", F.lit("` found")).alias("line"))

    left, summary = repair.dependencies_repaired(lines, log_of, 2)
    found = {}
    for r in sorted(left.collect(), key=lambda r: (r["file"], r["pos"])):
        found.setdefault(r["file"], []).append(r["line"])
    m = "# removed: "
    assert found == {"a": ["x = 1", m + "bad1 = 2", m + " bad2 = 3", m + "bad1 = 4", "# bad1"], "b": ["y = 1"], "c": ["z = 1"], "d": [m + "bad2 = 0", m + "bad3 = 0", "bad4 = 0"]}
    assert {(r["cycle"], r["file"], r["after"], r["kept"]) for r in summary.collect()} == {(1, "a", 1, True), (2, "a", 0, True), (1, "c", 1, False), (1, "d", 1, True), (2, "d", 1, True)}
