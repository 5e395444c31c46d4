"""Queries over joins, aggregates, set operations, ranks and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import classify as C
from millrace.operators import contain, graph, ranges, relate, retrieve, rollup, sequence, verify
from millrace.plans.by_rule import FAMILY, LANG, PRIORITY, RANK
from millrace.plans.catalog import query
from millrace.sources import tree


def _edges(t):
    return t.edges.select("src", "dst", "ord")


@query("j01_resolved_imports", """WITH f AS (SELECT doc_id AS n, concat('p/m', doc_id, '.py') AS path FROM documents)
    SELECT path, CAST(0 AS BIGINT) AS line_no, concat('p/m', n + 1, '.py') AS "to" FROM f WHERE concat('p/m', n + 1, '.py') IN (SELECT path FROM f)
    UNION ALL SELECT path, 1, concat('p/m', n + 2, '.py') FROM f WHERE concat('p/m', n + 2, '.py') IN (SELECT path FROM f)""")
def _(t):
    n = F.col("doc_id")
    name = lambda k: F.concat(F.lit("m"), (n + k).cast("string"))
    files = t.documents.select(F.concat(F.lit("p/"), name(0), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.concat(F.lit("import "), name(1), F.lit("\nfrom ."), name(2), F.lit(" import x\nimport os\nimport "), name(0)).alias("content"))
    return relate.resolved(C.imports(files), files).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("j02_inner_edges", "SELECT src, dst FROM edges WHERE starts_with(src, 'c')")
def _(t):
    nodes = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path")).unionByName(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path")))
    return relate.inner_edges(_edges(t), nodes).select("src", "dst")


@query("j03_neighbours", "SELECT node, CAST(sum(d) AS BIGINT) AS deps, CAST(sum(i) AS BIGINT) AS importers FROM (SELECT src AS node, 1 AS d, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def _(t):
    return relate.neighbours(_edges(t))


@query("j04_manifest_results", "SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return relate.with_results(t.documents, t.labels, "doc_id").select("doc_id", "lang", F.col("quality").cast("bigint").alias("quality"))


@query("j05_file_packages", "SELECT d.doc_id, coalesce('q' || l.quality, '') AS package FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    packages = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("package"))
    return relate.left_with(t.documents.select("doc_id"), packages, "doc_id", {"package": ""}).select("doc_id", "package")


@query("j06_own_and_imported", """WITH p AS (SELECT concat('c', c_custkey) AS path, c_mktsegment AS package FROM customer UNION ALL SELECT concat('n', n_nationkey), n_name FROM nation),
    u AS (SELECT path, package, 0 AS o FROM p UNION ALL SELECT e.src, p.package, 1 FROM edges e JOIN p ON p.path = e.dst)
    SELECT path, package, row_number() OVER (PARTITION BY path ORDER BY o, package) - 1 AS ord FROM (SELECT path, package, min(o) AS o FROM u GROUP BY 1, 2)""")
def _(t):
    packages = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("package")).unionByName(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("package")))
    return relate.packages_of(_edges(t), packages).withColumn("ord", F.col("ord").cast("bigint"))


#: Words and sentences of passages, as names: with dots, commas and spaces, many inside one another, in either case.
NAMES_SAID = "(SELECT item_id AS root, unnest(list_concat(string_split(text, ' '), string_split(text, '. '))) AS name FROM benchmark)"


def _said(t):
    return t.benchmark.select(F.col("item_id").alias("root"), F.explode(F.concat(F.split("text", " "), F.split("text", "\\. "))).alias("name"))


@query("j07_mentions", f"SELECT doc_id, name FROM documents JOIN (SELECT DISTINCT name FROM {NAMES_SAID}) ON contains(text, name)")
def _(t):
    return contain.mentions(t.documents, _said(t), "doc_id", "text", "name")


@query("j07_mentioned_roots", f"SELECT doc_id, name, root FROM documents JOIN (SELECT name, min(root) AS root FROM {NAMES_SAID} GROUP BY 1 HAVING count(DISTINCT root) = 1) ON contains(text, name)")
def _(t):
    return contain.mentioned_roots(t.documents, _said(t), "doc_id", "text")


@query("j08_attributed", f"SELECT split_part(file, '/', 2) AS root, count(*) AS errors FROM diags WHERE {RANK} >= 3 AND (code IS NULL OR code NOT IN ('E0432', 'E0433', 'E0405', 'E0412')) AND split_part(file, '/', 2) IN ('core', 'api') GROUP BY 1")
def _(t):
    return relate.attributed(t.diags, t.spark.createDataFrame([("core",), ("api",), ("zzz",)], "root string"))


@query("j09_by_suffix", """WITH d AS (SELECT ord, CASE ord % 6 WHEN 0 THEN path WHEN 1 THEN concat('/w/', path) WHEN 2 THEN concat('src\\do', path) WHEN 3 THEN replace(path, '/', '\\') WHEN 4 THEN regexp_replace(path, '^[^/]*/', '') ELSE 'mod.rs' END AS file FROM files),
    p AS (SELECT DISTINCT path FROM files UNION ALL SELECT 'mod.rs' UNION ALL SELECT '/w/src/core/mod.rs'),
    x AS (SELECT DISTINCT file, path FROM (SELECT DISTINCT file, replace(file, '\\', '/') AS a FROM d) JOIN (SELECT path, replace(path, '\\', '/') AS b FROM p) ON ends_with(a, b) OR ends_with(b, a))
    SELECT ord, file, path FROM d JOIN x USING (file)""")
def _(t):
    """Files with a folder or part of a name before them, other separators, or without their first folder; and a short one."""
    path, kind = F.col("path"), F.col("ord") % 6
    file = F.when(kind == 0, path).when(kind == 1, F.concat(F.lit("/w/"), path)).when(kind == 2, F.concat(F.lit("src\\do"), path)).when(kind == 3, F.translate(path, "/", "\\")).when(kind == 4, F.regexp_replace(path, "^[^/]*/", "")).otherwise("mod.rs")
    more = t.spark.createDataFrame([("mod.rs",), ("/w/src/core/mod.rs",)], "path string")
    return contain.by_suffix(t.files.select("ord", file.alias("file")), t.files.select("path").distinct().unionByName(more))


@query("j10_definitions", "SELECT i.use, i.n, it.module FROM (SELECT DISTINCT o_orderkey AS n, concat('Item_', o_orderkey % 500) AS use FROM orders) i JOIN items it ON it.name = i.use")
def _(t):
    uses = t.orders.select(F.col("o_orderkey").alias("n"), F.concat(F.lit("Item_"), (F.col("o_orderkey") % 500).cast("string")).alias("use")).distinct()
    return relate.defined(uses, t.items.select("name", "module")).select("use", "n", "module")


def _impls(t):
    return t.supplier.select(F.concat(F.lit("T"), (F.col("s_suppkey") % 7).cast("string")).alias("trait"), F.concat(F.lit("T"), (F.col("s_suppkey") % 5).cast("string")).alias("type"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("module"), F.col("s_suppkey").alias("id"))


@query("j11_trait_or_type", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 7 IN (1, 2) OR s_suppkey % 5 IN (1, 2)")
def _(t):
    return relate.of_trait_or_type(t.spark.createDataFrame([("T1",), ("T2",)], "name string"), _impls(t)).select("id")


@query("j12_search", "SELECT 'item' AS kind, concat('T', p_size % 9) AS name, concat('m', p_partkey % 4) AS module FROM part WHERE p_size % 9 = 3 UNION ALL SELECT 'impl', concat('T', s_suppkey % 7, ' for T', s_suppkey % 5), concat('m', s_nationkey) FROM supplier WHERE s_suppkey % 7 = 3 OR s_suppkey % 5 = 3")
def _(t):
    """A name that items have, and implementations as their trait, their type, or both."""
    items = t.part.select(F.concat(F.lit("T"), (F.col("p_size") % 9).cast("string")).alias("name"), F.concat(F.lit("m"), (F.col("p_partkey") % 4).cast("string")).alias("module"))
    return relate.searched(items, _impls(t), "T3")


@query("j13_import_targets", """WITH e AS (SELECT name, min(module) AS module FROM items GROUP BY 1 HAVING count(DISTINCT module) = 1)
    SELECT l.file, l.name, e.module FROM (SELECT o_orderkey AS file, concat('Item_', o_orderkey % 500) AS name FROM orders) l LEFT JOIN e USING (name)""")
def _(t):
    leaves = t.orders.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("Item_"), (F.col("o_orderkey") % 500).cast("string")).alias("name"))
    return relate.import_targets(leaves, t.items.select("name", "module"))


@query("j14_missing_dependencies", "SELECT DISTINCT concat('pkg-', p_size) AS package FROM part WHERE p_size % 2 = 0 AND p_size NOT IN (2, 4, 6)")
def _(t):
    name = lambda k: t.spark.createDataFrame([(f"dep-{k}",)], "name string")
    heads = t.part.select(F.concat(F.lit("dep_"), F.col("p_size").cast("string")).alias("head"))
    registry = t.spark.createDataFrame([(f"dep_{k}", f"pkg-{k}") for k in range(0, 200, 2)], "head string, package string")
    return relate.missing_dependencies(heads, name(2), name(4), name(6), registry)


@query("j15_heads_in_text", "SELECT DISTINCT 'rand' AS package FROM documents UNION ALL SELECT DISTINCT concat('pkg', doc_id % 3) FROM documents WHERE doc_id % 3 <> 2")
def _(t):
    code = F.concat(F.lit('let s = "serde::x"; // tokio::y\nuse rand::Rng; h'), (F.col("doc_id") % 3).cast("string"), F.lit("::f(); std::fs::read()"))
    heads = t.documents.select(F.explode(sequence.path_heads(code)).alias("head"))
    none = t.spark.createDataFrame([], "name string")
    registry = t.spark.createDataFrame([("rand", "rand"), ("h0", "pkg0"), ("h1", "pkg1"), ("serde", "serde"), ("tokio", "tokio"), ("fs", "fs")], "head string, package string")
    return relate.missing_dependencies(heads, none, none, none, registry)


@query("j16_derives_on_types", "SELECT module, name, 'Debug' AS trait FROM items WHERE name = 'Item_31' UNION ALL SELECT module, name, 'Clone' FROM items WHERE name = 'Item_31'")
def _(t):
    messages = t.spark.createDataFrame([("`a::Item_31` doesn't implement `Debug`",), ("the trait bound `Item_31<T>: Clone` is not satisfied",), ("`Item_31` doesn't implement `Send`",)], "message string")
    wanted = relate.derive_requests(messages).select(F.col("type").alias("use"), F.explode("traits").alias("trait"))
    return relate.defined(wanted, t.items.select("name", "module")).select("module", "name", "trait")


@query("j17_updated", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    new = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"))
    return relate.updated(t.customer.select("c_custkey", "c_mktsegment"), new, "c_custkey", "c_mktsegment")


@query("j18_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return relate.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("j19_zip", "SELECT d.doc_id, p.p_name FROM documents d JOIN part p ON p.p_partkey = d.doc_id")
def _(t):
    return relate.zipped(t.documents.select(F.col("doc_id").alias("ord"), "doc_id"), t.part.select(F.col("p_partkey").alias("ord"), "p_name"), "ord").select("doc_id", "p_name")


@query("j20_case_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ignore' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'normalized' ELSE 'exact' END END AS cmp FROM customer")
def _(t):
    cases = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "ignore").alias("cmp"))
    specs = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "normalized").alias("cmp"))
    return relate.with_defaults(cases, specs, "c_nationkey", ["cmp"]).select("c_custkey", "cmp")


STRIPPED = "regexp_replace({x}, '[ \\t\\r]+(\\n|$)', '\\1', 'g')"
MASKED = f"regexp_replace({STRIPPED}, 'id=[0-9]+', 'id=#', 'g')"
DIFFS = f"""SELECT *, CASE WHEN want_stdout IS NULL THEN 'golden' ELSE array_to_string(list_filter([
    CASE WHEN cmp_stdout = 'exact' AND want_stdout <> got_stdout OR cmp_stdout = 'normalized' AND {MASKED.format(x='want_stdout')} <> {MASKED.format(x='got_stdout')} THEN 'stdout' END,
    CASE WHEN cmp_stderr <> 'ignore' AND want_stderr <> got_stderr THEN 'stderr' END, CASE WHEN cmp_exit <> 'ignore' AND want_exit <> got_exit THEN 'exit' END], lambda x: x IS NOT NULL), ',') END AS diffs FROM cases"""
MASKS = [("id=[0-9]+", "id=#")]


@query("j21_golden_join", "SELECT name, want_stdout IS NOT NULL AS captured FROM cases")
def _(t):
    golden = t.cases.filter("want_stdout is not null").select("name", F.lit(True).alias("captured"))
    return relate.left_with(t.cases.select("name"), golden, "name", {"captured": False})


@query("i11_differences", f"SELECT name, diffs FROM ({DIFFS})")
def _(t):
    return verify.differences(t.cases, MASKS).select("name", F.array_join("diffs", ",").alias("diffs"))


@query("a11_verify_report", f"SELECT spec, count(*) FILTER (WHERE NOT nondeterministic AND diffs = '') AS matched, count(*) FILTER (WHERE NOT nondeterministic) AS total, count(*) FILTER (WHERE nondeterministic) AS quarantined, CASE WHEN count(*) FILTER (WHERE NOT nondeterministic) = 0 THEN 'unverified' WHEN count(*) FILTER (WHERE NOT nondeterministic AND diffs = '') = count(*) FILTER (WHERE NOT nondeterministic) THEN 'passed' ELSE 'failed' END AS verdict FROM ({DIFFS}) GROUP BY spec")
def _(t):
    return verify.report(verify.differences(t.cases, MASKS))


@query("i10_captured", "SELECT name, coalesce(want_stdout, '') <> got_stdout OR coalesce(want_exit, -1) <> got_exit AS nondeterministic FROM cases")
def _(t):
    one = t.cases.select("spec", "name", F.lit(1).alias("run"), F.coalesce("want_stdout", F.lit("")).alias("stdout"), F.lit("").alias("stderr"), F.coalesce("want_exit", F.lit(-1)).alias("exit_code"))
    two = t.cases.select("spec", "name", F.lit(2).alias("run"), F.col("got_stdout").alias("stdout"), F.lit("").alias("stderr"), F.col("got_exit").alias("exit_code"))
    return verify.captured(one.unionByName(two)).select("name", "nondeterministic")


@query("j22_leave_one_out", """WITH s AS (SELECT doc_id, lang, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS q, b.doc_id AS e, count(*) AS c FROM s a JOIN s b ON a.w = b.w AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY 1, 2)
    SELECT q AS query_id, e AS entry_id, round(c / (x.n + y.n - c), 9) AS jaccard FROM p JOIN z x ON x.doc_id = q JOIN z y ON y.doc_id = e""")
def _(t):
    return retrieve.among(t.documents.select(F.col("doc_id").alias("id"), "lang", F.array_distinct(F.split("text", " ")).alias("symbols")), 9)


TOP = """WITH q AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark), nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
    c AS (SELECT doc_id, strlen(text) AS b, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents), nc AS (SELECT doc_id, any_value(b) AS b, count(*) AS n FROM c GROUP BY 1),
    p AS (SELECT item_id, doc_id, count(*) AS k FROM q JOIN c USING (w) GROUP BY 1, 2),
    r AS (SELECT p.item_id, p.doc_id, k / (nq.n + nc.n - k) AS j, row_number() OVER (PARTITION BY p.item_id ORDER BY k / (nq.n + nc.n - k) DESC, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END DESC, p.doc_id % 2 DESC, nc.b, p.doc_id) AS rank FROM p JOIN nq USING (item_id) JOIN nc USING (doc_id) LEFT JOIN labels l ON l.doc_id = p.doc_id)"""


def _retrieval(t):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("x").alias("lang"), words("text").alias("symbols"))
    docs = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.lit("x").alias("lang"), words("text").alias("symbols"), F.when(F.col("quality") == 1, "behavior").otherwise("compile").alias("tier"), F.octet_length("text").alias("source_bytes"))
    corpus = retrieve.tagged(entries.filter("entry_id % 2 = 0"), entries.filter("entry_id % 2 = 1"))
    return queries, corpus


@query("t01_top_k", f"{TOP} SELECT item_id AS query_id, rank, doc_id AS entry_id, round(j, 9) AS jaccard FROM r WHERE rank <= 3")
def top_k(t):
    queries, corpus = _retrieval(t)
    return retrieve.top_k(queries, corpus).select("query_id", F.col("rank").cast("bigint").alias("rank"), "entry_id", F.round("jaccard", 9).alias("jaccard"))


@query("t02_tagged_sources", "SELECT doc_id AS entry_id, doc_id % 2 = 1 AS is_local FROM documents")
def _(t):
    return _retrieval(t)[1].select("entry_id", "is_local")


@query("a16_hit_rate", f"{TOP} SELECT count(*) AS queries, count(j) AS hits, round(coalesce(avg(j), 0), 9) AS mean_top1 FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND rank = 1")
def _(t):
    queries, corpus = _retrieval(t)
    return retrieve.hit_rate(queries, retrieve.top_k(queries, corpus, 1)).withColumn("mean_top1", F.round("mean_top1", 9))


@query("a01_top_language", f"SELECT lang, count(*) AS count FROM (SELECT {LANG} AS lang FROM files) WHERE lang IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t):
    return relate.top_by_count(t.files.select(C.language(F.col("path")).alias("lang")), "lang")


@query("a02_scan_summary", f"SELECT count(*) AS files, count({LANG}) AS sources, count(DISTINCT project) AS projects, CAST(sum(length) AS BIGINT) AS bytes FROM files")
def _(t):
    return t.files.agg(F.count("*").alias("files"), F.count(C.language(F.col("path"))).alias("sources"), F.count_distinct("project").alias("projects"), F.sum("length").alias("bytes"))


RANKED = f"SELECT family, CAST(priority AS BIGINT) AS priority, count, row_number() OVER (ORDER BY priority DESC, count DESC, family) AS rank FROM (SELECT family, {PRIORITY} AS priority, count(*) AS count FROM {FAMILY} WHERE {RANK} >= 3 GROUP BY 1)"


def _ranked(t):
    return C.ranked_families(t.diags).withColumns({"priority": F.col("priority").cast("bigint"), "rank": F.col("rank").cast("bigint")})


@query("a03_ranked_families", RANKED)
def _(t):
    return _ranked(t)


@query("t03_top_families", f"SELECT * FROM ({RANKED}) WHERE rank <= 3")
def _(t):
    return _ranked(t).filter("rank <= 3")


@query("a04_error_counts", f"SELECT run_id, count(*) FILTER (WHERE {RANK} >= 3) AS errors, count(*) FILTER (WHERE {RANK} = 3) AS plain_errors FROM diags GROUP BY 1")
def _(t):
    rank = C.level_rank(F.col("level"))
    return t.diags.groupBy("run_id").agg(F.count_if(rank >= 3).alias("errors"), F.count_if(rank == 3).alias("plain_errors"))


@query("a05_package_files", f"SELECT regexp_extract(path, '^(.*)/', 1) AS root, count(*) AS files, min(ord) AS first FROM files WHERE {LANG} IS NOT NULL AND contains(path, '/') GROUP BY 1")
def _(t):
    own = t.files.filter(C.language(F.col("path")).isNotNull() & F.col("path").contains("/"))
    return own.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("root")).agg(F.count("*").alias("files"), F.min("ord").alias("first"))


@query("a06_error_text", f"SELECT run_id, string_agg(message, chr(10) ORDER BY ord) AS text FROM (SELECT run_id, ord, substr(message, 1, CAST(4000 - start AS INTEGER)) AS message FROM (SELECT *, sum(strlen(message) + 1) OVER (PARTITION BY run_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - strlen(message) - 1 AS start FROM diags WHERE {RANK} >= 3) WHERE start < 4000) GROUP BY 1")
def _(t):
    return sequence.joined(C.errors(t.diags), "run_id", "ord", "message", 4000)


@query("a07_symbols_per_text", "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '\\b[a-z][A-Za-z0-9_]*(?:\\.|::)[A-Za-z_][A-Za-z0-9_]*'))) AS BIGINT) AS symbols FROM pages")
def _(t):
    return t.pages.select("page_id", F.size(T.api_surface(F.col("html"))).cast("bigint").alias("symbols"))


@query("a08_symbol_modules", "SELECT name, string_agg(DISTINCT module, ',' ORDER BY module) AS modules FROM items GROUP BY 1")
def _(t):
    return t.items.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"))


@query("a09_singletons", """WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('It_', p_partkey % (SELECT count(*) * 3 // 4 FROM part)) ELSE concat('it', p_partkey % (SELECT count(*) * 3 // 4 FROM part), '_') END AS name FROM part)
    SELECT lower(replace(name, '_', '')) AS key, min(name) AS name FROM n GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    """Two ways to write a name, of which half occur once."""
    number = F.col("p_partkey") % F.lit(t.part.count() * 3 // 4)
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("It_"), number.cast("string"))).otherwise(F.concat(F.lit("it"), number.cast("string"), F.lit("_")))
    return relate.singletons(t.part.select(name.alias("name")), T.segment_key(F.col("name")))


@query("a10_derive_traits", "SELECT 'Bar' AS \"type\", 'Debug' AS traits UNION ALL SELECT 'Foo', 'Clone'")
def _(t):
    return relate.derive_requests(t.diags).select("type", F.array_join("traits", ",").alias("traits"))


HEADLINE = "SELECT count(*) FILTER (WHERE expectation <> 'impossible' AND ran AND coalesce(clean, false)) AS clean, count(*) FILTER (WHERE expectation <> 'impossible' AND ran) AS achievable, median(CASE WHEN ran AND NOT coalesce(pipeline_failed, false) THEN errors END) AS median_errors, max(CASE WHEN name = 'repo7' AND ran AND NOT coalesce(pipeline_failed, false) THEN errors END) AS named_errors FROM manifest"


@query("a12_headline", HEADLINE)
def headline(t):
    return rollup.headline(t.manifest, "repo7")


@query("snk08_scoreboard", "SELECT name, CASE WHEN NOT ran THEN 'not run' WHEN coalesce(pipeline_failed, false) THEN 'pipeline failed' WHEN clean THEN 'clean' ELSE 'partial' END AS verdict, CASE WHEN ran AND NOT coalesce(pipeline_failed, false) THEN CAST(errors AS VARCHAR) ELSE '-' END AS errors, CASE WHEN ran AND NOT coalesce(pipeline_failed, false) THEN concat(translated, '/', total) ELSE '-' END AS files FROM manifest")
def _(t):
    return rollup.scoreboard(t.manifest)


@query("a13_file_outcomes", "SELECT source, count(*) FILTER (WHERE n_chars > 500) AS translated, count(*) FILTER (WHERE n_chars <= 500) AS failed FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count_if(F.col("n_chars") > 500).alias("translated"), F.count_if(F.col("n_chars") <= 500).alias("failed"))


@query("a14_todo_total", "SELECT module, count(*) FILTER (WHERE contains(src, 'todo!(')) AS todos FROM items GROUP BY 1")
def _(t):
    return t.items.groupBy("module").agg(F.sum(C.occurrences(F.col("src"), "todo!(")).alias("todos"))


@query("a15_arms", "SELECT arm, round(avg(m), 6) AS mean, min(lo) AS least, max(hi) AS most FROM (SELECT l_partkey % 40 AS item, l_returnflag AS arm, avg(e) AS m, min(e) AS lo, max(e) AS hi FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS e FROM lineitem) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    trials = t.lineitem.select((F.col("l_partkey") % 40).alias("item"), F.col("l_returnflag").alias("arm"), F.when(F.col("l_linenumber") == 3, -1).otherwise(F.col("l_quantity").cast("bigint")).alias("errors"))
    return rollup.arms(trials).withColumn("mean", F.round("mean", 6))


@query("a17_best_round", "SELECT o_custkey AS run_id, min_by(o_orderkey, (n, o_orderkey)) AS round, min(n) AS issues FROM (SELECT *, o_orderkey % 7 AS n FROM orders) GROUP BY 1")
def _(t):
    return relate.best_round(t.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("round"), (F.col("o_orderkey") % 7).alias("issues")))


@query("a18_extensions", "SELECT lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS extension, count(*) AS files FROM files GROUP BY 1")
def _(t):
    return tree.extensions(t.files)


@query("a19_signature_counts", "SELECT module, count(*) AS items, count(DISTINCT name) AS names FROM items GROUP BY 1")
def _(t):
    return t.items.groupBy("module").agg(F.count("*").alias("items"), F.count_distinct("name").alias("names"))


@query("a20_fingerprint", "SELECT project, sha256(concat_ws(':', count(*), " + ", ".join(f"sum(CAST('0x' || substr(d, {15 * k + 1}, 15) AS BIGINT))" for k in range(4)) + ")) AS fingerprint, count(*) AS files FROM (SELECT project, sha256(concat(path, ':', sha256(content))) AS d FROM files) GROUP BY 1")
def _(t):
    return tree.fingerprint(t.files)


@query("a21_edit_totals", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS edits, count(DISTINCT l_shipdate) AS passes FROM lineitem")
def _(t):
    return t.lineitem.agg(F.sum("l_linenumber").alias("edits"), F.count_distinct("l_shipdate").alias("passes"))


@query("a22_dropped_names", "SELECT o_custkey, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS dropped FROM orders GROUP BY 1")
def _(t):
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("old"), F.collect_set(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))).alias("new"))
    return sets.select("o_custkey", F.size(F.array_except("old", "new")).cast("bigint").alias("dropped"))


@query("a23_pass_changes", "SELECT run_id, pass, errors, errors - lag(errors) OVER (PARTITION BY run_id ORDER BY pass) AS change FROM (SELECT run_id, ord % 4 AS pass, count(*) AS errors FROM diags GROUP BY 1, 2)")
def _(t):
    return rollup.passes(t.diags.groupBy("run_id", (F.col("ord") % 4).alias("pass")).agg(F.count("*").alias("errors")))


@query("t04_sorted_paths", "SELECT project, string_agg(path, ',' ORDER BY path) AS paths FROM files GROUP BY 1")
def _(t):
    return t.files.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


@query("t05_shown_list", "SELECT project, string_agg(path, ',' ORDER BY path) FILTER (WHERE r <= 40) AS shown, greatest(count(*) - 40, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS r FROM files) GROUP BY 1")
def _(t):
    from millrace.sources.sinks import shown_list

    return shown_list(t.files, "project", "path")


@query("t06_descending_offsets", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey DESC) AS offsets FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_partkey"), asc=False), lambda x: x.cast("string")), ",").alias("offsets"))


@query("t07_first_lines", "SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)), 1, 3), '|') AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.slice(T.lines(F.col("text")), 1, 3), "|").alias("head"))


@query("t08_first_match", "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(t):
    return t.orders.filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"))


@query("d01_edges_once", "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def _(t):
    return relate.first_of(t.lineitem, ["l_orderkey", "l_suppkey"], ["l_linenumber"]).select("l_orderkey", "l_suppkey", "l_linenumber")


@query("d02_nodes", "SELECT path, min(o) AS ord FROM (SELECT concat('c', c_custkey) AS path, c_custkey AS o FROM customer UNION ALL SELECT src, ord * 2 + 1099511627776 FROM edges UNION ALL SELECT dst, ord * 2 + 1 + 1099511627776 FROM edges) GROUP BY 1")
def _(t):
    targets = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("ord"))
    return relate.nodes_of(targets, _edges(t))


@query("d03_set_sizes", "SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS every FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b FROM documents)")
def _(t):
    a, b = F.array_distinct(F.split("text", " ")), F.array_distinct(F.split(F.lower("text"), " "))
    return t.documents.select("doc_id", F.size(F.array_intersect(a, b)).cast("bigint").alias("common"), F.size(F.array_union(a, b)).cast("bigint").alias("every"))


@query("d04_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def _(t):
    return t.documents.select("doc_id").exceptAll(t.labels.filter("quality = 1").select("doc_id"))


KEY = "concat_ws(' ', CASE WHEN kind IN ('struct', 'enum', 'union', 'type') THEN 'type' ELSE kind END, name, coalesce(cfg, ''))"


@query("d05_best_items", f"SELECT module, pos FROM (SELECT *, row_number() OVER (PARTITION BY module, {KEY} ORDER BY NOT contains(src, 'todo!(') DESC, starts_with(trim(src), '///') DESC, strlen(trim(src)) DESC, pos) AS r FROM items) WHERE r = 1")
def _(t):
    return relate.best_items(t.items).select("module", "pos")


@query("d06_item_keys", f"SELECT pos, {KEY} AS key FROM items")
def _(t):
    return t.items.select("pos", relate.item_key(F.col("kind"), F.col("name"), F.col("cfg")).alias("key"))


@query("d07_verbatim_once", "SELECT module, min(pos) AS pos FROM items GROUP BY module, src")
def _(t):
    return relate.verbatim_once(t.items).select("module", "pos")


@query("d08_use_leaves", "SELECT p_partkey AS file, unnest(['a::b', concat('a::c', p_partkey % 3, '::d'), concat('a::c', p_partkey % 3, '::e')]) AS leaf FROM part")
def _(t):
    uses = t.part.select(F.col("p_partkey").alias("file"), F.concat(F.lit("pub use a::{b, c"), (F.col("p_partkey") % 3).cast("string"), F.lit("::{d, e}};")).alias("use"))
    return sequence.use_leaves(uses)


@query("d09_disjoint_ranges", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN '0-5,5-9' ELSE '2-4,9-12' END AS taken FROM part")
def _(t):
    at = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"))
    edits = F.when(F.col("p_partkey") % 2 == 0, F.array(at(0, 5), at(3, 7), at(5, 9))).otherwise(F.array(at(2, 4), at(0, 3), at(9, 12)))
    return t.part.select("p_partkey", F.array_join(F.transform(sequence.disjoint(edits), lambda e: F.concat_ws("-", e.start.cast("string"), e.end.cast("string"))), ",").alias("taken"))


#: Suggestions of two or three edits in files that many share; some insert, some replace much.
EDITS = """SELECT c_custkey AS suggestion, concat('f', c_nationkey % 5) AS file, (c_custkey * 7919) % 2000 AS start, c_custkey % 7 * (c_custkey % 3) AS size FROM customer
    UNION ALL SELECT c_custkey, concat('f', c_custkey % 5), (c_custkey * 104729) % 2000, c_custkey % 4 FROM customer
    UNION ALL SELECT c_custkey, 'f0', (c_custkey * 1299709) % 2000, c_custkey % 90 FROM customer WHERE c_custkey % 5 = 0"""


@query("d09_greedy_suggestions", f"""WITH RECURSIVE e AS ({EDITS}), s AS (SELECT suggestion, list({{'file': file, 'a': start, 'b': start + size}}) AS edits, row_number() OVER (ORDER BY suggestion) AS k FROM e GROUP BY 1),
    f AS (SELECT k, suggestion, true AS taken, edits AS used FROM s WHERE k = 1
    UNION ALL SELECT k, suggestion, taken, CASE WHEN taken THEN list_concat(used, edits) ELSE used END
    FROM (SELECT s.k, s.suggestion, s.edits, f.used, len(list_filter(s.edits, lambda x: len(list_filter(f.used, lambda u: u.file = x.file AND CASE WHEN x.a = x.b THEN u.a <= x.a AND x.a < u.b ELSE x.a < u.b AND u.a < x.b END)) > 0)) = 0 AS taken FROM f JOIN s ON s.k = f.k + 1))
    SELECT e.suggestion, e.file, e.start, e.start + e.size AS "end" FROM e JOIN f USING (suggestion) WHERE f.taken""")
def _(t):
    key = F.col("c_custkey")
    row = lambda file, start, size: t.customer.select(key.alias("suggestion"), file.alias("file"), start.alias("start"), (start + size).alias("end"))
    name = lambda n: F.concat(F.lit("f"), (n % 5).cast("string"))
    edits = row(name(F.col("c_nationkey")), key * 7919 % 2000, key % 7 * (key % 3)).unionByName(row(name(key), key * 104729 % 2000, key % 4))
    return ranges.disjoint_suggestions(edits.unionByName(row(F.lit("f0"), key * 1299709 % 2000, key % 90).filter("suggestion % 5 = 0")))


@query("d10_error_files", f"SELECT run_id, file, row_number() OVER (PARTITION BY run_id ORDER BY first, file) AS ord FROM (SELECT run_id, file, min(ord) AS first FROM diags WHERE {RANK} >= 3 GROUP BY 1, 2)")
def _(t):
    return relate.distinct_files(t.diags).withColumn("ord", F.col("ord").cast("bigint"))


@query("d11_distinct_arguments", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").dropDuplicates()


@query("d12_bag_union", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").unionByName(t.labels.select("doc_id"))


TWO = """(SELECT src, dst FROM edges UNION SELECT concat('o', o_orderkey), concat('c', c_custkey) FROM orders JOIN customer ON c_custkey = o_orderkey % 100 + 1)"""


@query("i01_levels", f"""WITH e AS {TWO}, n AS (SELECT path, CASE left(path, 1) WHEN 'o' THEN 3 WHEN 'c' THEN 2 WHEN 'n' THEN 1 ELSE 0 END AS level, CAST(substr(path, 2) AS BIGINT) AS ord FROM (SELECT src AS path FROM e UNION SELECT dst FROM e)),
    l0 AS (SELECT path, row_number() OVER (ORDER BY ord) AS spot FROM n WHERE level = 0),
    l1 AS (SELECT n.path, row_number() OVER (ORDER BY max(spot), n.ord) AS spot FROM n JOIN e ON e.src = n.path JOIN l0 ON l0.path = e.dst GROUP BY n.path, n.ord),
    l2 AS (SELECT n.path, row_number() OVER (ORDER BY max(spot), n.ord) AS spot FROM n JOIN e ON e.src = n.path JOIN l1 ON l1.path = e.dst GROUP BY n.path, n.ord),
    l3 AS (SELECT n.path, row_number() OVER (ORDER BY max(spot), n.ord) AS spot FROM n JOIN e ON e.src = n.path JOIN l2 ON l2.path = e.dst GROUP BY n.path, n.ord),
    every AS (SELECT path, 0 AS level, spot FROM l0 UNION ALL SELECT path, 1, spot FROM l1 UNION ALL SELECT path, 2, spot FROM l2 UNION ALL SELECT path, 3, spot FROM l3)
    SELECT path, CAST(level AS BIGINT) AS level, row_number() OVER (ORDER BY level, spot) - 1 AS place FROM every""")
def _(t):
    """Orders depend on two customers, these on their nation, and nations on their region."""
    number = F.col("o_orderkey") % 100 + 1
    more = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), number.alias("c_custkey")).join(t.customer.select("c_custkey"), "c_custkey")
    edges = _edges(t).select("src", "dst").unionByName(more.select("src", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst")))
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    return graph.queue_order(nodes.withColumn("ord", F.substring("path", 2, 20).cast("bigint")), edges)


@query("i01_chains_and_cycles", """WITH c AS (SELECT concat('c', c_custkey) AS path, c_custkey AS ord, c_custkey % 25 AS chain, c_custkey // 25 AS step FROM customer),
    n AS (SELECT path, ord, CASE WHEN chain IN (3, 4) AND step >= 1 THEN NULL ELSE step END AS level, chain AS root FROM c
        UNION ALL SELECT concat('o', o_orderkey), 1000000000 + o_orderkey, CASE WHEN chain IN (3, 4) AND step >= 1 THEN NULL ELSE step + 1 END, chain FROM orders JOIN c ON c.ord = o_custkey)
    SELECT path, CAST(level AS BIGINT) AS level, row_number() OVER (ORDER BY level NULLS LAST, CASE WHEN level IS NULL THEN 0 ELSE root END, ord) - 1 AS place FROM n""")
def _(t):
    """Chains of customers, as long as the table lets them be, with orders on them; two chains come back to themselves, and all behind that hangs on it."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    edge = lambda rows, a, b: rows.select(a.alias("src"), b.alias("dst"))
    customers = t.customer.select("c_custkey")
    edges = edge(customers.filter("c_custkey >= 25"), name(key), name(key - 25))
    edges = edges.unionByName(edge(customers.filter("c_custkey in (28, 29)"), name(key), name(key + 75)))
    orders = t.orders.select("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("c_custkey")).join(customers, "c_custkey")
    edges = edges.unionByName(edge(orders, F.col("path"), name(key)))
    nodes = customers.select(name(key).alias("path"), key.alias("ord")).unionByName(orders.select("path", (F.col("o_orderkey") + 1000000000).alias("ord")))
    return graph.queue_order(nodes, edges)


NAMES = "SELECT p_partkey AS ord, concat('n', p_partkey % 150) AS name, concat('f', p_size % 3, '/n', p_size % 5, '/', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('D-', p_partkey % 7, '/') END, 'n', p_partkey % 150) AS path FROM part UNION ALL SELECT 1000000 + p_partkey, concat('n', p_partkey % 20, '_', p_size % 4 + 2), 'x' FROM part WHERE p_partkey % 40 = 1"


@query("i09_unique_names", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY ord) AS k, [lower(replace(x, '-', '_')) FOR x IN string_split(path, '/')] AS seg FROM ({NAMES})),
    c AS (SELECT k, ord, list_concat([name], [array_to_string(seg[len(seg) - n + 1:], '_') FOR n IN range(2, len(seg) + 1)], [concat(name, '_', n) FOR n IN range(2, 60)]) AS choices FROM r),
    u AS (SELECT k, ord, choices[1] AS "unique", [choices[1]] AS used FROM c WHERE k = 1
    UNION ALL SELECT k, ord, pick, list_append(used, pick) FROM (SELECT c.k, c.ord, used, list_filter(choices, lambda x: NOT list_contains(used, x))[1] AS pick FROM u JOIN c ON c.k = u.k + 1))
    SELECT ord, "unique" FROM u""")
def _(t):
    n = lambda c, m: (F.col(c) % m).cast("string")
    name = F.concat(F.lit("n"), n("p_partkey", 150))
    folder = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("D-"), n("p_partkey", 7), F.lit("/")))
    rows = t.part.select(F.col("p_partkey").alias("ord"), name.alias("name"), F.concat(F.lit("f"), n("p_size", 3), F.lit("/n"), n("p_size", 5), F.lit("/"), folder, name).alias("path"))
    taken = t.part.filter("p_partkey % 40 = 1").select((F.col("p_partkey") + 1000000).alias("ord"), F.concat(F.lit("n"), n("p_partkey", 20), F.lit("_"), (F.col("p_size") % 4 + 2).cast("string")).alias("name"), F.lit("x").alias("path"))
    return graph.unique_names(rows.unionByName(taken)).select("ord", "unique")
