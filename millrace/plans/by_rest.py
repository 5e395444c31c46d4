"""Queries over a real tree, streams of reads, gates, writers and checks of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import sequence, verify
from millrace.plans.by_set import DIFFS, MASKS
from millrace.plans.catalog import query
from millrace.sources import sinks, tree, walk
from millrace.sources.durable import folder
from millrace.streaming import progress

#: A tree of files with their sizes; a third of it is no source.
TREE = {"src/main.py": 9, "src/a b/it's.py": 3, "src/.hidden/x.py": 4, "node_modules/m/y.js": 5, "lib/util.go": 0, ".git/config": 7, "lib/build/z.go": 2, "docs/big.md": 500_001, "docs/edge.md": 500_000, "README.md": 1}


@query("src01_real_tree", "SELECT * FROM (VALUES ('src/main.py', 9), ('src/a b/it''s.py', 3), ('docs/edge.md', 500000), ('README.md', 1)) v(path, length)")
def _(t):
    root = folder(t.spark, "tree o'clock")
    jvm = t.spark.sparkContext._jvm
    for path, size in TREE.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        out = p.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        out.writeBytes("x" * size)
        out.close()
    return tree.scan(t.spark, root).select("path", F.length("content").cast("bigint").alias("length"))


@query("src01_pruned_tree", """SELECT path, CAST(max(length) AS BIGINT) AS length FROM (SELECT concat(project, '/', path) AS path, CASE WHEN ord % 11 = 0 THEN 0 ELSE length END AS length, row_number() OVER (PARTITION BY project, path ORDER BY ord) AS k FROM files)
    WHERE k = 1 AND length <= 5000 AND NOT regexp_matches(path, '(^|/)(\\.[^/]*|node_modules|__pycache__|__MACOSX|venv|dist|build|target)(/|$)') GROUP BY 1""")
def _(t):
    """The documents as files of a tree, some without a byte; hidden and skipped folders are never listed."""
    from pyspark.sql import Window

    root = folder(t.spark, "tree")
    first = t.files.withColumn("k", F.row_number().over(Window.partitionBy("project", "path").orderBy("ord"))).filter("k = 1")
    walk.planted(first.select(F.concat_ws("/", "project", "path").alias("path"), F.when(F.col("ord") % 11 == 0, "").otherwise(F.col("content")).alias("content")), root)
    return walk.scan(t.spark, root, most=5000).select("path", F.length("content").cast("bigint").alias("length"))


@query("src21_event_reads", "SELECT run_id, seq, kind FROM progress WHERE seq % 10 NOT IN (3, 4, 5)")
def _(t):
    """Lines are cut anywhere, some reads hold the end of one and the beginning of the next, and some lines are no events."""
    good = F.concat(F.lit("data: "), F.to_json(F.struct("run_id", "seq", "kind", "stage", "ts")), F.lit("\\\n\\\n"))
    line = F.when(F.col("seq") % 10 == 3, F.lit("data: {broken\\\n")).when(F.col("seq") % 10 == 4, F.lit(": still here\\\r\\\n")).when(F.col("seq") % 10 == 5, F.lit("data:  \\\n")).otherwise(good)
    cut = (F.col("seq") % 23 + 1).cast("int")
    halves = F.array(F.substring(line, F.lit(1), cut), F.substring(line, cut + 1, F.length(line)))
    reads = t.progress.select("run_id", "seq", F.posexplode(halves).alias("half", "read")).select("run_id", (F.col("seq") * 2 + F.col("half")).alias("at"), "read")
    found = progress.events_of_reads(reads, "run_id", "at", "read")
    return progress.parsed(found.select(F.col("json").alias("value"))).select("run_id", "seq", "kind")


@query("src21_event_stream", "SELECT run_id, seq, kind FROM progress WHERE seq % 10 NOT IN (3, 4, 5)")
def _(t):
    """Each run's stream is a file; reads are 97 bytes, wherever that cuts. The second half of the runs comes to a stream that starts again."""
    from millrace.sources.durable import folder
    from millrace.streaming import reads

    event = F.concat(F.lit("data: "), F.to_json(F.struct("run_id", "seq", "kind", "stage", "ts", F.lit("é日").alias("text"))))
    line = F.when(F.col("seq") % 10 == 3, "data: {broken").when(F.col("seq") % 10 == 4, ": still here\r").when(F.col("seq") % 10 == 5, "data:  ").otherwise(event)
    inbox, out, checkpoint = (folder(t.spark, x) for x in ("streams", "events", "reads"))
    for half in (0, 1):
        own = t.progress.filter(F.col("run_id") % 2 == half)
        own.select(F.col("run_id").alias("run"), line.alias("value")).repartition("run").sortWithinPartitions("run").write.mode("append").partitionBy("run").text(inbox)
        reads.read_once(t.spark, inbox, out, checkpoint, 97)
    found = t.spark.read.schema("stream string, n bigint, json string").parquet(out)
    return progress.parsed(found.select(F.col("json").alias("value"))).select("run_id", "seq", "kind")


@query("st06_rate_gate", """WITH r AS (SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS came FROM events), n AS (SELECT *, row_number() OVER (ORDER BY came, event_id) * 900 AS n FROM r)
    SELECT event_id, CAST(n + max(came - n) OVER (ORDER BY n) AS BIGINT) AS fires FROM n""")
def _(t):
    """One gate for all requests."""
    return progress.gated(t.events.select("event_id", F.unix_timestamp("ts").alias("came")), "came", "event_id", 900).select("event_id", "fires")


@query("st06_gate_of_workers", """WITH RECURSIVE r AS (SELECT user_id % 50 AS worker, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS came, row_number() OVER (PARTITION BY user_id % 50 ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT), event_id) AS k FROM events),
    f AS (SELECT worker, event_id, k, came AS fires FROM r WHERE k = 1 UNION ALL SELECT r.worker, r.event_id, r.k, greatest(r.came, f.fires + 40000) FROM f JOIN r ON r.worker = f.worker AND r.k = f.k + 1)
    SELECT event_id, fires FROM f""")
def _(t):
    """One gate for each worker."""
    requests = t.events.select((F.col("user_id") % 50).alias("worker"), "event_id", F.unix_timestamp("ts").alias("came"))
    return progress.gated(requests, "came", "event_id", 40000, ["worker"]).select("event_id", "fires")


@query("st07_single_run", """WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, o_orderkey // 4 AS b, o_orderkey // 4 + o_orderkey % 9 * 2000 AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 4, o_orderkey) AS k FROM orders),
    f AS (SELECT o_custkey, o_orderkey, k, true AS admitted, e AS busy FROM r WHERE k = 1
    UNION ALL SELECT r.o_custkey, r.o_orderkey, r.k, r.b >= f.busy, CASE WHEN r.b >= f.busy THEN r.e ELSE f.busy END FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.k = f.k + 1)
    SELECT o_orderkey, admitted FROM f""")
def _(t):
    begin = F.expr("o_orderkey div 4")
    runs = t.orders.select("o_custkey", "o_orderkey", begin.alias("begin"), (begin + F.col("o_orderkey") % 9 * 2000).alias("end"))
    return progress.admitted(runs, "o_custkey", "begin", "end", "o_orderkey").select("o_orderkey", "admitted")


@query("snk06_zip", "SELECT 's' || s_nationkey AS archive, concat('s', s_nationkey, '/src/', s_suppkey, '.rs') AS name, s_name AS content FROM supplier WHERE s_suppkey % 3 <> 0")
def _(t):
    """Archives are packed and unpacked again; a third of the files is build output."""
    path = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "target/debug/").otherwise("src/"), F.col("s_suppkey").cast("string"), F.lit(".rs"))
    files = t.supplier.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("project"), path.alias("path"), F.col("s_name").alias("content"))
    return tree.unzip(tree.zipped(files)).withColumn("content", F.decode("content", "UTF-8"))


@query("snk07_reports", f"""WITH v AS (SELECT spec, count(*) FILTER (WHERE NOT nondeterministic AND diffs = '') AS matched, count(*) FILTER (WHERE NOT nondeterministic) AS total, count(*) FILTER (WHERE nondeterministic) AS quarantined FROM ({DIFFS}) GROUP BY spec),
    y AS (SELECT spec, concat('cases:', chr(10), string_agg(concat('- name: ''', name, '''', CASE WHEN c <> '' THEN concat(chr(10), '  compare: {{', c, '}}') ELSE '' END, CASE WHEN nondeterministic THEN concat(chr(10), '  nondeterministic: true') ELSE '' END), chr(10) ORDER BY name), chr(10)) AS yaml
    FROM (SELECT *, concat_ws(', ', CASE WHEN cmp_stdout <> 'exact' THEN 'stdout: ' || cmp_stdout END, CASE WHEN cmp_stderr <> 'exact' THEN 'stderr: ' || cmp_stderr END, CASE WHEN cmp_exit <> 'exact' THEN 'exit: ' || cmp_exit END) AS c FROM cases) GROUP BY 1)
    SELECT v.spec, concat('{{"matched":', matched, ',"total":', total, ',"quarantined":', quarantined, ',"verdict":"', CASE WHEN total = 0 THEN 'unverified' WHEN matched = total THEN 'passed' ELSE 'failed' END, '"}}') AS json, yaml FROM v JOIN y USING (spec)""")
def _(t):
    report = verify.report(verify.differences(t.cases, MASKS))
    return sinks.report_json(report).join(sinks.cases_yaml(t.cases), "spec")


#: Endings of code, of which some leave it open.
ENDINGS = ("}", "", "\n}\n// )", "}}", "/* } */ }", '"}"', '"open }', "')' }", "(]) }")


@query("i13_parse_gate", "SELECT p_partkey, CASE WHEN p_partkey % 9 IN (0, 2, 4, 7) THEN concat('fn f', p_size, '() { ', CASE p_partkey % 9 WHEN 0 THEN '}' WHEN 2 THEN concat(chr(10), '}', chr(10), '// )') WHEN 4 THEN '/* } */ }' ELSE ''')'' }' END) ELSE concat('// TODO: no valid translation of `p', p_size, '.go`: the output was truncated or invalid and needs a manual port.', chr(10)) END AS code, p_partkey % 9 NOT IN (0, 2, 4, 7) AS stubbed FROM part")
def _(t):
    size = F.col("p_size").cast("string")
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    gate = sequence.parse_gate(F.concat(F.lit("fn f"), size, F.lit("() { "), end), F.concat(F.lit("p"), size, F.lit(".go")))
    return t.part.select("p_partkey", gate.alias("g")).select("p_partkey", "g.*")


@query("f32_arithmetic", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN n + 2 * m WHEN 1 THEN (n + 2) * m WHEN 2 THEN n - m - 3 WHEN 3 THEN pow(2, pow(2, m % 4)) WHEN 4 THEN pow(-n, 2) / 4 WHEN 5 THEN CASE WHEN m % 3 > 0 THEN n / (m % 3) END WHEN 6 THEN pow(n, 2) + 0.5 END AS value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, p_partkey % 100 AS m FROM part)")
def _(t):
    n, m = F.col("p_size").cast("string"), F.col("p_partkey") % 100
    s = m.cast("string")
    text = F.element_at(F.array(F.concat(n, F.lit(" + 2*"), s), F.concat(F.lit("("), n, F.lit("+2) * "), s), F.concat(n, F.lit("-"), s, F.lit("-3")), F.concat(F.lit("2^2^"), (m % 4).cast("string")), F.concat(F.lit("-"), n, F.lit("^2 / 4")), F.concat(n, F.lit("/ "), (m % 3).cast("string")), F.concat(n, F.lit("^2.9 + .5")), F.concat(n, F.lit(" + (2"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", sequence.arithmetic(text).alias("value"))
