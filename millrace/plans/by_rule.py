"""Queries over rule classifiers and text functions (sources, projections, scalars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import classify as C
from millrace.operators import relate
from millrace.plans.catalog import query
from millrace.sources import records, tree

EXT = "CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^.+\\.') THEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) ELSE '' END"
LANG = f"""CASE {EXT} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
    WHEN 'go' THEN 'go' WHEN 'cpp' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'c++' THEN 'cpp' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' END"""
NAME = "regexp_extract(path, '[^/]*$')"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]*$', '\\1')"


@query("src01_tree_scan", "SELECT ord, path FROM files WHERE NOT regexp_matches(path, '(^|/)(\\.[^/]*|node_modules|__pycache__|__MACOSX|venv|dist|build|target)(/|$)')")
def _(t):
    return t.files.filter(tree.visible(F.col("path"))).select("ord", "path")


@query("src02_size_guard", "SELECT ord, length FROM files WHERE length <= 500000")
def _(t):
    return t.files.filter(tree.small_enough(F.col("length"))).select("ord", "length")


@query("src03_json_lines", "SELECT doc_id, lang AS source_lang, text AS source_code FROM documents WHERE doc_id % 5 NOT IN (1, 2)")
def _(t):
    good = F.to_json(F.struct(F.col("lang").alias("source_lang"), F.array(F.lit("a.b")).alias("source_api"), F.col("text").alias("source_code"), F.lit("x").alias("target_code"), F.lit("p").alias("package"), F.lit("f").alias("file"), F.lit("compile").alias("tier")))
    line = F.when(F.col("doc_id") % 5 == 1, F.lit("  ")).when(F.col("doc_id") % 5 == 2, F.lit('{"source_lang": "go"')).otherwise(good)
    return records.json_lines(t.documents.select("doc_id", line.alias("value")), records.CORPUS, ["source_lang", "source_api", "source_code", "target_code", "package", "file", "tier"]).select("doc_id", "source_lang", "source_code")


def _log(t):
    """A compiler's log of JSON messages, with lines that are none."""
    span = F.struct(F.col("file").alias("file_name"), F.col("ord").alias("line_start"), F.col("ord").alias("line_end"), F.lit(1).alias("column_start"), F.lit(2).alias("column_end"), F.when(F.col("ord") % 4 != 0, F.col("ord") * 10).alias("byte_start"), (F.col("ord") * 10 + 3).alias("byte_end"), F.lit(True).alias("is_primary"), F.when(F.col("ord") % 6 == 0, F.lit("a /* b")).otherwise(F.lit("fix")).alias("suggested_replacement"), F.when(F.col("ord") % 3 == 0, F.lit("MachineApplicable")).otherwise(F.lit("MaybeIncorrect")).alias("suggestion_applicability"))
    message = F.to_json(F.struct(F.when(F.col("ord") % 10 == 7, F.lit("build-finished")).otherwise(F.lit("compiler-message")).alias("reason"), F.struct(F.when(F.col("ord") % 8 != 1, F.col("level")).alias("level"), "message", F.struct("code").alias("code"), F.array(span).alias("spans"), F.array(F.struct(F.lit("help").alias("level"), F.lit("try").alias("message"), F.array(span).alias("spans"))).alias("children")).alias("message")))
    line = F.when(F.col("ord") % 10 == 9, F.lit("   Compiling x v0.1")).otherwise(message)
    return t.diags.select("run_id", F.col("ord").alias("line_no"), line.alias("value"))


@query("src06_log_diagnostics", "SELECT ord AS line_no, CASE WHEN ord % 8 = 1 THEN 'note' ELSE level END AS level, code, message FROM diags WHERE ord % 10 NOT IN (7, 9)")
def _(t):
    return records.diagnostics(_log(t)).select("line_no", "level", "code", "message")


@query("src07_log_spans", "SELECT ord AS line_no, CAST(CASE WHEN ord % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS spans FROM diags WHERE ord % 10 NOT IN (7, 9)")
def _(t):
    return records.diagnostics(_log(t)).select("line_no", F.size("spans").cast("bigint").alias("spans"))


@query("src08_suggestions", "SELECT ord AS line_no, file, CASE WHEN ord % 4 <> 0 THEN ord * 10 END AS start, ord * 10 + 3 AS \"end\", 'fix' AS replacement, CAST(pos AS BIGINT) AS pos FROM diags, (VALUES (0), (1)) v(pos) WHERE ord % 10 NOT IN (7, 9) AND ord % 3 = 0 AND ord % 6 <> 0")
def _(t):
    return records.suggestions(_log(t), ["MachineApplicable"]).select("line_no", "file", "start", "end", "replacement", F.col("pos").cast("bigint").alias("pos"))


@query("src11_markdown_commands", "SELECT doc_id, CAST(0 AS BIGINT) AS ord, 'readme_0' AS name, concat('run|', doc_id % 3) AS args FROM documents UNION ALL SELECT doc_id, 1, 'readme_1', 'a b' FROM documents")
def _(t):
    text = F.concat(F.lit("intro calc run\n```sh\n$ calc run "), (F.col("doc_id") % 3).cast("string"), F.lit("\nother x\n$ calc 'a b'\n```\ncalc no\n```\ncalc run "), (F.col("doc_id") % 3).cast("string"), F.lit("\n```\n"))
    found = records.mined_commands(t.documents.select("doc_id", text.alias("text"), F.lit("calc").alias("binary")))
    return found.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "name", F.array_join("args", "|").alias("args"))


@query("src12_help_case", "SELECT doc_id % 10 AS k, 'help' AS name, '--help' AS args FROM documents GROUP BY 1 UNION ALL SELECT doc_id % 10, concat('c', doc_id), 'x' FROM documents")
def _(t):
    cases = t.documents.select((F.col("doc_id") % 10).alias("k"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("name"), F.array(F.lit("x")).alias("args"))
    return records.with_help_case(cases).select("k", "name", F.array_join("args", " ").alias("args"))


def _outputs(t):
    """Translated files with marked regions; the second isn't ended, the third is blank."""
    body = F.concat(F.lit("head\n<<<src=a.go>>>\nfn a() {}\n"), F.col("lang"), F.lit("\n<<<end>>>\nbetween\n<<<src=b.go>>>\n  \n<<<end>>>\n<<<src=c.go>>>\nlast "), F.col("doc_id").cast("string"))
    return t.documents.select(F.col("doc_id").alias("file"), body.alias("text"))


@query("src13_regions", "SELECT doc_id AS file, 'a.go' AS path, concat('fn a() {}', chr(10), lang) AS body FROM documents UNION ALL SELECT doc_id, 'c.go', concat('last ', doc_id) FROM documents")
def _(t):
    return records.regions(_outputs(t))


@query("src14_harvest", "SELECT 'a.go' AS path, 'package a' AS source, concat('fn a() {}', chr(10), lang) AS target FROM documents")
def _(t):
    sources = t.spark.createDataFrame([("a.go", "package a"), ("z.go", "package z")], "path string, content string")
    return records.harvested(_outputs(t), sources)


@query("src15_report_tier", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'behavior' ELSE 'compile' END AS tier FROM events")
def _(t):
    report = F.when(F.col("event_id") % 3 == 0, F.lit('{"passed": true}')).when(F.col("event_id") % 3 == 1, F.lit('{"passed": false}')).otherwise(F.lit("not json"))
    return t.events.select("event_id", records.report_tier(report).alias("tier"))


@query("src17_common_root", "SELECT project AS archive, CASE WHEN count(DISTINCT split_part(path, '/', 1)) = 1 AND bool_or(contains(path, '/')) THEN min(split_part(path, '/', 1)) END AS root FROM files GROUP BY 1")
def _(t):
    return tree.common_root(t.files.select(F.col("project").alias("archive"), F.col("path").alias("name")))


MANIFEST = "[package]\nname = \"x\"\n[dependencies]\nserde = \"1\"\n# no\nlib{n} = { version = \"2\" }\n[dev-dependencies]\ntest = \"1\"\n# removed: old{n} = \"1\""


def _manifests(t):
    return t.documents.select(F.col("doc_id").alias("file"), F.replace(F.lit(MANIFEST), F.lit("{n}"), (F.col("doc_id") % 4).cast("string")).alias("text"))


@query("src18_section_names", "SELECT doc_id AS file, 'serde' AS name FROM documents UNION ALL SELECT doc_id, concat('lib', doc_id % 4) FROM documents")
def _(t):
    return records.section_names(_manifests(t), "dependencies")


@query("src19_removed_names", "SELECT doc_id AS file, concat('old', doc_id % 4) AS name FROM documents")
def _(t):
    return records.removed_names(_manifests(t))


@query("src20_dependency_hints", "SELECT doc_id AS file, 'rand' AS name, '0.9' AS version FROM documents UNION ALL SELECT doc_id, 'log', concat('^1.', doc_id % 7) FROM documents")
def _(t):
    text = F.concat(F.lit('  // [DEPS] rand = "0.8", log = "^1.'), (F.col("doc_id") % 7).cast("string"), F.lit('" (optional), std = "1", 2x = "1", bad = "latest"\nfn x() {}\n// [DEPS] rand = "0.9"'))
    return records.dependency_hints(t.documents.select(F.col("doc_id").alias("file"), text.alias("text")))


@query("src22_last_json", "SELECT user_id AS run_id, max_by(props, event_id) AS json FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def _(t):
    lines = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 == 0, F.lit("done {")).otherwise(F.col("props")).alias("line"))
    return records.last_json(lines)


@query("src23_first_object", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('{\"a\": {\"b\": \"}\"}, \"k\": ', event_id, '}') WHEN 1 THEN '{\"f\": 1}' END AS object FROM events")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('so } {"a": {"b": "}"}, "k": '), F.col("event_id").cast("string"), F.lit("} and {x}"))).when(F.col("event_id") % 3 == 1, F.lit('{"no": 0}\n```json\n{"f": 1}\n```')).otherwise(F.lit("open { only"))
    return t.events.select("event_id", records.first_object(text).alias("object"))


@query("src24_package_manager", "SELECT project, min_by(manager, k) AS manager FROM (SELECT source AS project, doc_id % 8 AS k, CASE doc_id % 8 WHEN 0 THEN 'pip' WHEN 1 THEN 'pip/poetry' WHEN 2 THEN 'pipenv' WHEN 3 THEN 'npm/yarn' WHEN 4 THEN 'go modules' WHEN 5 THEN 'bundler' WHEN 6 THEN 'maven' ELSE 'gradle' END AS manager FROM documents) GROUP BY 1")
def _(t):
    name = F.element_at(F.array(*[F.lit(f) for f, _ in tree.PACKAGE_MARKERS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return tree.package_manager(t.documents.select(F.col("source").alias("project"), name.alias("path")))


@query("r01_language", f"SELECT ord, {LANG} AS lang FROM files WHERE {LANG} IS NOT NULL")
def _(t):
    return t.files.select("ord", C.language(F.col("path")).alias("lang")).filter("lang is not null")


@query("r02_display_names", f"SELECT ord, CASE {LANG} WHEN 'python' THEN 'Python' WHEN 'typescript' THEN 'TypeScript' WHEN 'javascript' THEN 'JavaScript' WHEN 'go' THEN 'Go' WHEN 'cpp' THEN 'C++' WHEN 'c' THEN 'C' WHEN 'java' THEN 'Java' WHEN 'csharp' THEN 'C#' WHEN 'ruby' THEN 'Ruby' END AS shown FROM files")
def _(t):
    return t.files.select("ord", C.display(C.language(F.col("path"))).alias("shown"))


@query("r03_dynamic", f"SELECT ord, {LANG} IN ('python', 'javascript', 'ruby') AS dynamic FROM files WHERE {LANG} IS NOT NULL")
def _(t):
    return t.files.withColumn("lang", C.language(F.col("path"))).filter("lang is not null").select("ord", C.dynamic(F.col("lang")).alias("dynamic"))


ENTRY = f"CASE {LANG} WHEN 'python' THEN lower({STEM}) IN ('main', '__main__', 'app', 'run') WHEN 'go' THEN lower({STEM}) = 'main' WHEN 'javascript' THEN lower({STEM}) IN ('index', 'main', 'server', 'app') WHEN 'typescript' THEN lower({STEM}) IN ('index', 'main', 'server', 'app') WHEN 'java' THEN lower({STEM}) IN ('main', 'app', 'application') ELSE lower({STEM}) = 'main' END"


@query("r04_entrypoint", f"SELECT ord, {ENTRY} AS entry FROM files WHERE {LANG} IS NOT NULL")
def _(t):
    return t.files.withColumn("lang", C.language(F.col("path"))).filter("lang is not null").select("ord", C.is_entry(F.col("path"), F.col("lang")).alias("entry"))


@query("r05_entry_files", f"SELECT path FROM files WHERE {LANG} IS NOT NULL AND {ENTRY}")
def _(t):
    return t.files.withColumn("lang", C.language(F.col("path"))).filter(C.is_entry(F.col("path"), F.col("lang")) & F.col("lang").isNotNull()).select("path")


def _code(t):
    """Files with import lines in their language, after some of their own."""
    n = (F.col("ord") % 6).cast("string")
    lines = F.concat_ws("\n", F.lit("x = 1"), F.concat(F.lit("from .util"), n, F.lit(" import y")), F.concat(F.lit("import App"), n), F.concat(F.lit("import z from './main"), F.lit("';")), F.concat(F.lit('#include "main.h"')), F.lit('"fmt"'), F.lit("end"))
    return t.files.select("ord", "path", C.language(F.col("path")).alias("lang"), lines.alias("content"))


@query("r06_imports", f"""SELECT ord, line_no, symbol FROM (SELECT ord, CASE WHEN l IN ('python') THEN [struct_pack(n := 1, s := concat('.util', ord % 6)), struct_pack(n := 2, s := concat('App', ord % 6)), struct_pack(n := 3, s := 'z')] WHEN l IN ('javascript', 'typescript') THEN [struct_pack(n := 3, s := './main')] WHEN l = 'go' THEN [struct_pack(n := 5, s := 'fmt')] WHEN l IN ('c', 'cpp') THEN [struct_pack(n := 4, s := 'main.h')] ELSE [] END AS r FROM (SELECT ord, {LANG} AS l FROM files)), LATERAL (SELECT CAST(x.n AS BIGINT) AS line_no, x.s AS symbol FROM (SELECT unnest(r) AS x))""")
def _(t):
    found = C.imports(_code(t).withColumn("path", F.col("ord").cast("string")))
    return found.select(F.col("path").cast("bigint").alias("ord"), F.col("line_no").cast("bigint").alias("line_no"), "symbol")


@query("r07_no_self_import", "SELECT src, dst FROM (SELECT o_orderkey % 50 AS src, o_custkey % 50 AS dst FROM orders) WHERE src <> dst")
def _(t):
    return relate.between_files(t.orders.select((F.col("o_orderkey") % 50).alias("src"), (F.col("o_custkey") % 50).alias("dst")))


# The families of diagnostics, spelled out once more for the checking engine.
BY_CODE = (
    "CASE WHEN code IN ('E0106', 'E0495', 'E0597', 'E0621', 'E0622', 'E0623', 'E0700') THEN 'MissingLifetime' WHEN code IN ('E0277', 'E0283', 'E0284', 'E0369', 'E0391', "
    "'E0275') THEN CASE WHEN (contains(m, 'send')) OR (contains(m, 'sync')) OR (contains(m, 'future')) OR (contains(m, 'async')) OR (contains(m, 'unpin')) THEN 'AsyncMismatch' "
    "ELSE 'TraitBoundFailure' END WHEN code IN ('E0382', 'E0505', 'E0506', 'E0507', 'E0508', 'E0509') THEN 'OwnershipMove' WHEN code IN ('E0499', 'E0500', 'E0501', 'E0502', "
    "'E0503', 'E0504', 'E0515', 'E0521') THEN 'BorrowConflict' WHEN code IN ('E0308', 'E0309', 'E0310', 'E0365', 'E0606', 'E0607') THEN CASE WHEN (contains(m, 'integer')) OR "
    "(contains(m, 'overflow')) OR (contains(m, 'truncat')) THEN 'IntegerOverflow' ELSE 'TypeMismatch' END WHEN code IN ('E0412', 'E0422', 'E0423', 'E0425', 'E0432', 'E0433', "
    "'E0603', 'E0614') THEN 'MissingImport' WHEN code IN ('E0728', 'E0752', 'E0753', 'E0654', 'E0746') THEN 'AsyncMismatch' WHEN code IN ('E0004', 'E0005') THEN "
    "'PatternExhaustiveness' WHEN code IN ('E0021') THEN 'InternalCompilerError' END"
)
BY_TEXT = (
    "CASE WHEN (contains(m, 'lifetime')) OR (contains(m, 'does not live long enough')) OR (contains(m, 'borrowed value does not live')) THEN 'MissingLifetime' WHEN "
    "(contains(m, 'cannot move out')) OR (contains(m, 'use of moved value')) OR (contains(m, 'moved out of')) THEN 'OwnershipMove' WHEN (contains(m, 'cannot borrow')) OR "
    "(contains(m, 'borrow of moved value')) OR (contains(m, 'two mutable borrows')) THEN 'BorrowConflict' WHEN (contains(m, 'send') AND contains(m, 'not implemented')) OR "
    "(contains(m, 'future') AND contains(m, 'not implemented')) OR (contains(m, 'async')) OR (contains(m, 'await')) THEN 'AsyncMismatch' WHEN (contains(m, 'the trait') AND "
    "contains(m, 'is not implemented')) OR (contains(m, 'trait bound')) THEN 'TraitBoundFailure' WHEN (contains(m, 'mismatched types')) OR (contains(m, 'expected') AND "
    "contains(m, 'found')) THEN 'TypeMismatch' WHEN (contains(m, 'unresolved import')) OR (contains(m, 'not found in this scope')) OR (contains(m, 'no module named')) OR "
    "(contains(m, 'cannot find')) THEN 'MissingImport' WHEN (contains(m, 'overflow')) OR (contains(m, 'truncat')) THEN 'IntegerOverflow' WHEN (contains(m, 'macro')) THEN "
    "'MacroError' WHEN (contains(m, 'non-exhaustive')) OR (contains(m, 'pattern') AND contains(m, 'not covered')) THEN 'PatternExhaustiveness' WHEN (contains(m, 'unused')) OR "
    "(contains(m, 'dead code')) THEN 'UnusedCode' WHEN (contains(m, 'internal compiler error')) THEN 'InternalCompilerError' ELSE 'Other' END"
)
FAMILY = f"(SELECT *, coalesce({BY_CODE}, {BY_TEXT}) AS family FROM (SELECT *, lower(message) AS m FROM diags))"
DIMENSION = (
    "(VALUES ('MissingImport', 10, true), ('UnusedCode', 9, true), ('TypeMismatch', 8, true), ('IntegerOverflow', 8, true), ('PatternExhaustiveness', 7, true), "
    "('TraitBoundFailure', 6, false), ('MacroError', 5, false), ('AsyncMismatch', 5, false), ('Other', 4, false), ('BorrowConflict', 3, false), ('OwnershipMove', 3, false), "
    "('MissingLifetime', 2, false), ('InternalCompilerError', 0, false)) d(family, priority, auto_fixable)"
)
PRIORITY = (
    "CASE family WHEN 'MissingImport' THEN 10 WHEN 'UnusedCode' THEN 9 WHEN 'TypeMismatch' THEN 8 WHEN 'IntegerOverflow' THEN 8 WHEN 'PatternExhaustiveness' THEN 7 WHEN "
    "'TraitBoundFailure' THEN 6 WHEN 'MacroError' THEN 5 WHEN 'AsyncMismatch' THEN 5 WHEN 'Other' THEN 4 WHEN 'BorrowConflict' THEN 3 WHEN 'OwnershipMove' THEN 3 WHEN "
    "'MissingLifetime' THEN 2 WHEN 'InternalCompilerError' THEN 0 END"
)
RANK = "CASE level WHEN 'help' THEN 0 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'error: internal compiler error' THEN 4 ELSE 1 END"


@query("r08_family_by_code", f"SELECT ord, {BY_CODE} AS family FROM (SELECT *, lower(message) AS m FROM diags) WHERE {BY_CODE} IS NOT NULL")
def _(t):
    known = [c for codes in C.CODES.values() for c in codes]
    return t.diags.filter(F.col("code").isin(*known)).select("ord", C.family(F.col("code"), F.col("message")).alias("family"))


@query("r09_family", f"SELECT ord, family, CASE WHEN family = 'Other' THEN coalesce(code, 'unknown') END AS detail FROM {FAMILY}")
def _(t):
    name = C.family(F.col("code"), F.col("message"))
    return t.diags.select("ord", name.alias("family"), C.family_detail(F.col("code"), name).alias("detail"))


@query("r10_level_rank", f"SELECT ord, CAST({RANK} AS BIGINT) AS level_rank FROM diags")
def _(t):
    return t.diags.select("ord", C.level_rank(F.col("level")).cast("bigint").alias("level_rank"))


@query("r11_family_dimension", f"SELECT f.ord, CAST(priority AS BIGINT) AS priority, auto_fixable FROM {FAMILY} f JOIN {DIMENSION} ON f.family = d.family")
def _(t):
    diags = t.diags.withColumn("family", C.family(F.col("code"), F.col("message")))
    return diags.join(F.broadcast(C.families(t.spark)), "family").select("ord", F.col("priority").cast("bigint").alias("priority"), "auto_fixable")


@query("r12_errors", f"SELECT ord FROM diags WHERE {RANK} >= 3")
def _(t):
    return C.errors(t.diags).select("ord")


STUB = f"""CASE WHEN strlen(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 16 THEN 'empty file'
    WHEN starts_with(lower({NAME}), 'test_') OR regexp_matches(lower({NAME}), '(_test\\.(go|py)|\\.(test|spec)\\.(ts|js))$') OR lower({NAME}) IN ('tests.py', 'test.py') THEN 'test file'
    WHEN regexp_matches(lower(path), '/(test|tests|testdata|__tests__|test-support|e2e|fixtures|mocks|mock|stubs|fakes|fake)/') THEN 'test/fixture path'
    WHEN regexp_matches(lower({NAME}), '(\\.generated\\.(ts|js|py)|\\.gen\\.go|\\.pb\\.go|_pb2\\.py|_grpc\\.py|\\.g\\.dart)$') THEN 'generated file' END"""


@query("r13_stub_reason", f"SELECT ord, {STUB} AS reason FROM files")
def _(t):
    return t.files.select("ord", C.stub_reason(F.col("path"), F.col("content")).alias("reason"))


@query("r14_tier", "SELECT ord, CASE WHEN length // 4 < 400 THEN 'fast' WHEN length // 4 < 3000 THEN 'mid' ELSE 'full' END AS tier FROM files")
def _(t):
    return t.files.select("ord", C.tier(T.tokens_down(F.col("content"))).alias("tier"))


@query("r15_native_library", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'openssl' WHEN 1 THEN 'libgit2' WHEN 2 THEN 'unknown' WHEN 3 THEN 'gtk4' END AS library FROM events")
def _(t):
    name = F.element_at(F.array(*map(F.lit, ("OpenSSL-sys", "git2", "foo-sys", "cairo-rs", "rand"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", C.native_library(name).alias("library"))


@query("r16_import_codes", "SELECT ord FROM diags WHERE code IS NULL OR code NOT IN ('E0432', 'E0433', 'E0405', 'E0412')")
def _(t):
    return t.diags.filter(C.not_import(F.col("code"))).select("ord")


@query("r17_real_replacement", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (2, 3)")
def _(t):
    text = F.element_at(F.array(*map(F.lit, ("a /* x */", "fn f() { ... }", "x + 1", "&y"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.filter(records.real_replacement(text)).select("doc_id")


@query("r18_derivable", "SELECT p_partkey FROM part WHERE p_partkey % 4 < 2")
def _(t):
    name = F.element_at(F.array(*map(F.lit, ("Debug", "Hash", "Display", "Send"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.filter(name.isin(*C.DERIVABLE)).select("p_partkey")


@query("r19_confined", "SELECT ord FROM files WHERE starts_with(path, 'src/') AND ord % 6 <> 0")
def _(t):
    return t.files.filter(C.confined(F.when(F.col("ord") % 6 == 0, F.concat(F.lit("src/../"), "path")).otherwise(F.col("path")))).select("ord")


@query("r20_same_suffix", "SELECT a.ord, true AS same FROM files a UNION ALL SELECT ord, false FROM files")
def _(t):
    windows = F.concat(F.lit("C:\\w\\"), F.translate("path", "/", "\\"))
    a = t.files.select("ord", C.same_suffix(windows, F.col("path")).alias("same"))
    return a.unionByName(t.files.select("ord", C.same_suffix(F.concat("path", F.lit("x")), F.col("path")).alias("same")))


@query("r21_output_state", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'stub' WHEN 1 THEN 'failed' ELSE 'ok' END AS state, CAST(CASE doc_id % 4 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS todos FROM documents")
def _(t):
    text = F.element_at(F.array(*map(F.lit, ("// [STUB] Skipped\n// read error:", "// read error: x", "todo!(); todo!()", "fn main() {}"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", C.output_state(text).alias("state"), C.occurrences(text, "todo!(").alias("todos"))


@query("r22_not_junk", "SELECT doc_id FROM documents WHERE doc_id % 4 = 3")
def _(t):
    name = F.element_at(F.array(*map(F.lit, ("__MACOSX/a.py", "src/._a.py", "x/.DS_Store", "src/a.py"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.filter(tree.not_junk(name)).select("doc_id")


@query("r23_outcome", "SELECT name, CASE WHEN NOT ran THEN 'not run' WHEN coalesce(pipeline_failed, false) THEN 'pipeline failed' WHEN clean THEN 'clean' ELSE 'partial' END AS verdict FROM manifest")
def _(t):
    return t.manifest.select("name", F.when(~F.col("ran"), "not run").otherwise(C.outcome(F.col("clean"), F.col("pipeline_failed"))).alias("verdict"))


def _resolver_log(t):
    n = (F.col("event_id") % 9).cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("error: no matching package named `p"), n, F.lit(' = "1"` found'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("searched package name: `q"), n, F.lit("`"))).when(F.col("event_id") % 4 == 2, F.lit("required by package `axios v1`")).otherwise(F.concat(F.lit("failed to get `r"), n, F.lit("` as a dependency of `x`")))
    return t.events.select((F.col("user_id") % 20).alias("run_id"), text.alias("line"))


@query("r24_unresolvable", "SELECT DISTINCT user_id % 20 AS run_id, concat(CASE event_id % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'q' ELSE 'r' END, event_id % 9) AS name FROM events WHERE event_id % 4 <> 2")
def _(t):
    return C.unresolvable(_resolver_log(t))


@query("r25_commented_out", "SELECT doc_id AS file, count(*) FILTER (WHERE doc_id % 4 = 2) AS removed FROM documents GROUP BY 1")
def _(t):
    lines = records.numbered(_manifests(t), "file", "text")
    names = t.spark.createDataFrame([("lib2",), ("none",)], "name string")
    return C.commented_out(lines, names, "#- ").groupBy("file").agg(F.count_if(F.col("line").startswith("#- lib")).alias("removed"))


@query("r26_public_declaration", "SELECT p_partkey, p_partkey % 3 = 0 AS public FROM part")
def _(t):
    line = F.element_at(F.array(*map(F.lit, ("  pub fn x() {", "fn y() {", "// pub fn z"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", C.declares_public(line).alias("public"))


BOUNDARIES = [("python", "  async def go(self):", "go"), ("python", "LIMIT = 3", "LIMIT"), ("python", "x = 3", None), ("typescript", "export const a = 1", "a"), ("javascript", "function f<T>(x)", "f"), ("go", "func Parse(x int) {", "Parse"), ("go", "return x", None), ("java", "public class Foo {", "public"), ("java", "  class Inner {", None), ("c", "int main(void) {", "int"), ("c", "#define X", None), ("ruby", "def call x", "call")]


@query("r27_boundary", "SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (_, _, n) in enumerate(BOUNDARIES) if n) + " END AS symbol FROM part")
def _(t):
    pick = lambda k: F.element_at(F.array(*[F.lit(b[k]) for b in BOUNDARIES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return t.part.select("p_partkey", C.boundary(pick(1), pick(0)).alias("symbol"))


@query("r28_api_files", f"SELECT project, count(*) AS blocks, CAST(sum(length) AS BIGINT) AS bytes FROM (SELECT *, sum(length) OVER (PARTITION BY project ORDER BY ord ROWS UNBOUNDED PRECEDING) - length AS before FROM files WHERE {LANG} IS NOT NULL AND NOT regexp_matches(lower(path), 'test|docs|setup')) WHERE before < 12000 GROUP BY 1")
def _(t):
    keep = t.files.filter(C.language(F.col("path")).isNotNull() & ~F.lower("path").rlike("test|docs|setup"))
    from pyspark.sql import Window

    run = Window.partitionBy("project").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return keep.withColumn("_before", F.sum("length").over(run) - F.col("length")).filter("_before < 12000").groupBy("project").agg(F.count("*").alias("blocks"), F.sum("length").alias("bytes"))


@query("r29_acceptable", "SELECT n, n <= 2 AS ok FROM (SELECT DISTINCT o_orderkey % 8 AS n FROM orders)")
def _(t):
    old = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: x.cast("string"))
    lost = t.orders.select((F.col("o_orderkey") % 8).cast("bigint").alias("n")).distinct()
    return lost.select("n", C.acceptable(old, F.slice(old, F.lit(1), 20 - F.col("n").cast("int"))).alias("ok"))


@query("r30_stage_percent", "SELECT seq, CAST(CASE stage WHEN 'Parsing' THEN 5 WHEN 'Scaffolding' THEN 10 WHEN 'Translating' THEN 15 WHEN 'Verifying' THEN 70 WHEN 'Optimizing' THEN 88 ELSE 50 END AS BIGINT) AS percent FROM progress")
def _(t):
    return t.progress.select("seq", C.stage_percent(F.col("stage")).cast("bigint").alias("percent"))


@query("r31_manifest_has", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'declared' ELSE 'MISSING' END AS state FROM documents")
def _(t):
    return _manifests(t).select(F.col("file").alias("doc_id"), C.manifest_has(F.col("text"), F.lit("lib1")).alias("state"))


@query("r32_history_card", "SELECT doc_id AS id, round(n_chars * 37 / 1024, 1) AS kb, CAST(least(100, greatest(6, round(n_chars * 37 / 200000 * 100))) AS BIGINT) AS bar, CASE WHEN doc_id % 3 = 0 THEN 'rust' ELSE lang END AS lang FROM documents")
def _(t):
    return C.card(t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") * 37).alias("bytes"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("lang")))


@query("f01_api_surface", "SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '\\b[a-z][A-Za-z0-9_]*(?:\\.|::)[A-Za-z_][A-Za-z0-9_]*'), lambda s: replace(s, '::', '.')))), ',') AS symbols FROM pages")
def _(t):
    return t.pages.select("page_id", F.array_join(T.api_surface(F.col("html")), ",").alias("symbols"))


@query("f02_token_estimates", "SELECT ord, CAST(ceil(length / 4.0) AS BIGINT) AS up, CAST(length // 4 AS BIGINT) AS down FROM files")
def _(t):
    return t.files.select("ord", T.tokens_up(F.col("content")).alias("up"), T.tokens_down(F.col("content")).alias("down"))


@query("f03_lexical_path", "SELECT ord, CASE WHEN ord % 2 = 0 THEN path ELSE concat('b/', path) END AS path FROM files")
def _(t):
    odd = F.concat(F.lit("./a/../b//./"), "path")
    return t.files.select("ord", T.lexical_path(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("../"), "path")).otherwise(odd)).alias("path"))


SAFE = "regexp_replace(lower({x}), '[^a-z0-9_]', '_', 'g')"


@query("f04_package_name", f"SELECT ord, CASE WHEN replace(s, '_', '') = '' THEN 'app' WHEN regexp_matches(s, '^[0-9]') THEN concat('crate_', s) ELSE s END AS name FROM (SELECT ord, {SAFE.format(x='n')} AS s FROM (SELECT ord, CASE ord % 3 WHEN 0 THEN path WHEN 1 THEN concat(ord, '-x') ELSE '--' END AS n FROM files))")
def _(t):
    return t.files.select("ord", T.package_name(F.when(F.col("ord") % 3 == 0, F.col("path")).when(F.col("ord") % 3 == 1, F.concat(F.col("ord").cast("string"), F.lit("-x"))).otherwise(F.lit("--"))).alias("name"))


@query("f05_project_name", "SELECT ord, CASE ord % 3 WHEN 0 THEN 'my_app' WHEN 1 THEN concat('project_', ord) ELSE 'project' END AS name FROM files")
def _(t):
    return t.files.select("ord", T.project_name(F.when(F.col("ord") % 3 == 0, F.lit("/tmp/My-App_")).when(F.col("ord") % 3 == 1, F.concat(F.lit("x/"), F.col("ord").cast("string"))).otherwise(F.lit("a/__"))).alias("name"))


@query("f06_identifier", f"SELECT ord, CASE WHEN regexp_matches(s, '^[0-9]') THEN concat('m_', s) ELSE s END AS name FROM (SELECT ord, {SAFE.format(x='concat(ord % 3 * 7, path)')} AS s FROM files)")
def _(t):
    return t.files.select("ord", T.identifier(F.concat((F.col("ord") % 3 * 7).cast("string"), "path")).alias("name"))


FLAT = f"concat(replace(regexp_extract(path, '^(.*/)', 1), '/', '_'), {STEM}, CASE WHEN {EXT} = 'h' THEN '_h' ELSE '' END)"


@query("f07_flat_module", f"SELECT ord, concat({SAFE.format(x=FLAT)}, '.rs') AS module FROM files")
def _(t):
    return t.files.select("ord", T.flat_module(F.col("path")).alias("module"))


@query("f08_package_of", f"SELECT ord, CASE WHEN ord % 2 = 0 AND contains(path, '/') THEN {SAFE.format(x='list_extract(string_split(path, chr(47)), -2)')} ELSE {SAFE.format(x=STEM)} || CASE WHEN {EXT} = 'h' THEN '_h' ELSE '' END END AS package FROM files")
def _(t):
    return t.files.select("ord", T.package_of(F.col("path"), F.col("ord") % 2 == 0).alias("package"))


@query("f09_dependency_name", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'libc' WHEN 1 THEN 'ncp-sys' END AS name FROM part")
def _(t):
    raw = F.element_at(F.array(*map(F.lit, (' "libc" ', "ncp-sys", "std", "2foo", "foo bar", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", T.dependency_name(raw).alias("name"))


@query("f10_dependency_version", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '0.2' WHEN 1 THEN '^1.2' WHEN 2 THEN '*' WHEN 4 THEN '~2.0.1' END AS version FROM part")
def _(t):
    raw = F.element_at(F.array(*map(F.lit, ('"0.2" (optional)', "^1.2", "*", '"latest"', "~2.0.1."))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", T.dependency_version(raw).alias("version"))


@query("f11_segment_key", "SELECT p_partkey, lower(replace(replace(p_name, ' ', '_'), '_', '')) AS key FROM part")
def _(t):
    return t.part.select("p_partkey", T.segment_key(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("key"))


@query("f12_jaccard", "SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b FROM documents)")
def _(t):
    words = lambda c: F.array_distinct(F.split(c, " "))
    return t.documents.select("doc_id", F.round(T.jaccard(words("text"), words(F.lower("text"))), 9).alias("jaccard"))


@query("f13_first_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 101 THEN text ELSE list_aggregate(list_transform(list_filter(range(1, 102), lambda n: strlen(substr(text, 1, n)) <= 101), lambda n: substr(text, 1, n)), 'last') END AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", T.first_bytes(F.col("text"), 101).alias("head"))


@query("f14_backticks", "SELECT ord, CASE WHEN regexp_matches(message, '`[^`]*`') THEN regexp_extract(message, '`([^`]*)`', 1) END AS first, array_to_string(regexp_extract_all(message, '`([^`]+)`', 1), ',') AS words FROM diags")
def _(t):
    m = F.col("message")
    return t.diags.select("ord", T.between_backticks(m).alias("first"), F.array_join(T.backtick_words(m), ",").alias("words"))


@query("f15_trait_requests", "SELECT ord, CASE event WHEN 5 THEN 'crate::a::Foo<T>' ELSE 'Bar' END AS \"type\", CASE event WHEN 5 THEN 'Clone' ELSE 'Debug' END AS trait FROM (SELECT ord, ord % 16 AS event FROM diags) WHERE event IN (5, 6)")
def _(t):
    return t.diags.select("ord", F.explode(T.trait_requests(F.col("message"))).alias("r")).select("ord", F.col("r.type").alias("type"), F.col("r.trait").alias("trait"))


@query("f16_simple_type", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'KyResponse' WHEN 1 THEN 'Foo' WHEN 4 THEN '_X' END AS name FROM part")
def _(t):
    raw = F.element_at(F.array(*map(F.lit, ("KyResponse<T>", "crate::types::Foo", "&str", "dyn Fn()", "_X"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", T.simple_type(raw).alias("name"))


@query("f17_module_of", f"SELECT ord, CASE WHEN starts_with(path, 'src/') THEN split_part(path, '/', 2) END AS module FROM files WHERE {EXT} <> 'rs' AND (NOT starts_with(path, 'src/') OR len(string_split(path, '/')) > 2) UNION ALL SELECT ord, CASE ord % 3 WHEN 0 THEN 'foo' END FROM files")
def _(t):
    a = t.files.filter("not path like 'src/%' or size(split(path, '/')) > 2").select("ord", T.module_of(F.col("path")).alias("module"))
    raw = F.element_at(F.array(*map(F.lit, ("src/foo.rs", "src/main.rs", "lib/foo.rs"))), (F.col("ord") % 3 + 1).cast("int"))
    return a.unionByName(t.files.select("ord", T.module_of(raw).alias("module")))


@query("f18_declared_name", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'foo' WHEN 1 THEN 'Bar' WHEN 2 THEN 'go' ELSE 'MAX' END AS name FROM part")
def _(t):
    raw = F.element_at(F.array(*map(F.lit, ("pub fn foo(x: i32)", "pub struct Bar", "pub async fn go<T>()", "pub const MAX: u8"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", T.declared_name(raw).alias("name"))


@query("f19_normalize", "SELECT doc_id, regexp_replace(regexp_replace(concat(text, '  ', chr(10)), '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '[0-9]+', '<n>', 'g') AS text FROM documents")
def _(t):
    from millrace.operators.verify import normalized

    return t.documents.select("doc_id", normalized(F.concat("text", F.lit("  \n")), [("[0-9]+", "<n>"), ("(", "bad")]).alias("text"))


@query("f20_fnv1a")
def _(t):
    from millrace.operators.sequence import fnv1a

    return t.documents.select("doc_id", fnv1a("text").alias("fnv"))


@query("f21_canonical", "SELECT doc_id, concat('a=true', chr(10), lang) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.canonical(F.concat(F.lit("  a=True \n\n  "), "lang", F.lit("  \n"))).alias("text"))


@query("f22_without_fences", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('x ', lang) ELSE lang END AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.without_fences(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so:\n```rs\nx "), "lang", F.lit("\n```\nend"))).otherwise(F.concat(F.lit(" "), "lang", F.lit("\n")))).alias("text"))


@query("f23_json_probe", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("f24_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS secs FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_timestamp("ts").alias("secs"))


@query("f25_percent_encoding", "SELECT doc_id, url_encode(text) AS encoded FROM documents")
def _(t):
    return t.documents.select("doc_id", T.percent_encoded(F.col("text")).alias("encoded"))


@query("f26_shell_words", "SELECT doc_id, concat('calc|a b|/w', doc_id) AS words FROM documents")
def _(t):
    words = records.shell_words(F.lit("calc 'a b' {work}"))
    return t.documents.select("doc_id", F.array_join(T.expand(words, F.concat(F.lit("/w"), F.col("doc_id").cast("string"))), "|").alias("words"))


@query("f27_public_lines", "SELECT doc_id, concat('pub fn a() {', chr(10), '  let x;', chr(10), 'use b;', chr(10), 'pub struct ', lang) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.public_lines(F.concat(F.lit("fn a() {\n  let x;\nuse b;\nstruct "), "lang")).alias("text"))


@query("f28_byte_edits", "SELECT doc_id, concat('é<', lang, '> b') AS text FROM documents")
def _(t):
    from millrace.operators.sequence import edited

    edit = lambda a, b, r: F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"), r.alias("replacement"))
    return t.documents.select("doc_id", edited(F.lit("éaa b"), F.array(edit(2, 4, F.concat(F.lit("<"), "lang", F.lit(">"))), edit(1, 2, F.lit("?")))).alias("text"))


@query("f29_lines", "SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))) AS BIGINT) AS lines FROM documents WHERE text <> ''")
def _(t):
    return t.documents.filter("text <> ''").select("doc_id", F.size(T.lines(F.col("text"))).cast("bigint").alias("lines"))


@query("f30_round_robin", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 AS key FROM conversations")
def _(t):
    from millrace.operators.sequence import renumbered

    return renumbered(t.conversations.select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", (F.col("place") % 3).cast("bigint").alias("key"))


@query("f31_first_filled", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", T.first_filled(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.lit("  ")), F.col("source")).alias("value"))
