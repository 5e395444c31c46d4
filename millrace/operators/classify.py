"""Rule classifiers: languages, entry points, imports, diagnostics, stubs, tiers, boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# Languages by file extension, and their display names.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "go": "go", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "c++": "cpp", "c": "c", "h": "c", "java": "java", "cs": "csharp", "rb": "ruby"}
DISPLAY = {"python": "Python", "typescript": "TypeScript", "javascript": "JavaScript", "go": "Go", "cpp": "C++", "c": "C", "java": "Java", "csharp": "C#", "ruby": "Ruby"}
DYNAMIC = ("python", "javascript", "ruby")
BY_FOLDER = ("go", "python", "javascript", "typescript", "java", "ruby")
# File stems that start a program, by language; any other language has main only.
ENTRY_STEMS = {"python": ("main", "__main__", "app", "run"), "go": ("main",), "javascript": ("index", "main", "server", "app"), "typescript": ("index", "main", "server", "app"), "java": ("main", "app", "application")}
# Levels of diagnostics, with their rank.
LEVELS = {"help": 0, "note": 1, "failure-note": 1, "warning": 2, "error": 3, "error: internal compiler error": 4}
# Families of diagnostics by error code.
CODES = {
    "MissingLifetime": ("E0106", "E0495", "E0597", "E0621", "E0622", "E0623", "E0700"),
    "TraitBoundFailure": ("E0277", "E0283", "E0284", "E0369", "E0391", "E0275"),
    "OwnershipMove": ("E0382", "E0505", "E0506", "E0507", "E0508", "E0509"),
    "BorrowConflict": ("E0499", "E0500", "E0501", "E0502", "E0503", "E0504", "E0515", "E0521"),
    "TypeMismatch": ("E0308", "E0309", "E0310", "E0365", "E0606", "E0607"),
    "MissingImport": ("E0412", "E0422", "E0423", "E0425", "E0432", "E0433", "E0603", "E0614"),
    "AsyncMismatch": ("E0728", "E0752", "E0753", "E0654", "E0746"),
    "PatternExhaustiveness": ("E0004", "E0005"),
    "InternalCompilerError": ("E0021",),
}
# In these families by code, words of the message that make it another family.
REFINED = {"TraitBoundFailure": ("AsyncMismatch", ("send", "sync", "future", "async", "unpin")), "TypeMismatch": ("IntegerOverflow", ("integer", "overflow", "truncat"))}
# Families by message, first match wins; a rule is alternatives of words that all occur.
MESSAGES = (
    ("MissingLifetime", (("lifetime",), ("does not live long enough",), ("borrowed value does not live",))),
    ("OwnershipMove", (("cannot move out",), ("use of moved value",), ("moved out of",))),
    ("BorrowConflict", (("cannot borrow",), ("borrow of moved value",), ("two mutable borrows",))),
    ("AsyncMismatch", (("send", "not implemented"), ("future", "not implemented"), ("async",), ("await",))),
    ("TraitBoundFailure", (("the trait", "is not implemented"), ("trait bound",))),
    ("TypeMismatch", (("mismatched types",), ("expected", "found"))),
    ("MissingImport", (("unresolved import",), ("not found in this scope",), ("no module named",), ("cannot find",))),
    ("IntegerOverflow", (("overflow",), ("truncat",))),
    ("MacroError", (("macro",),)),
    ("PatternExhaustiveness", (("non-exhaustive",), ("pattern", "not covered"))),
    ("UnusedCode", (("unused",), ("dead code",))),
    ("InternalCompilerError", (("internal compiler error",),)),
)
# Family, priority of repair (10 first), whether it repairs itself.
FAMILIES = (("MissingImport", 10, True), ("UnusedCode", 9, True), ("TypeMismatch", 8, True), ("IntegerOverflow", 8, True), ("PatternExhaustiveness", 7, True), ("TraitBoundFailure", 6, False), ("MacroError", 5, False), ("AsyncMismatch", 5, False), ("Other", 4, False), ("BorrowConflict", 3, False), ("OwnershipMove", 3, False), ("MissingLifetime", 2, False), ("InternalCompilerError", 0, False))
# Native libraries that packages need.
NATIVE = {"openssl": "openssl", "openssl-sys": "openssl", "ssh2": "libssh2", "libssh2-sys": "libssh2", "pq-sys": "libpq", "libpq-sys": "libpq", "postgres": "libpq", "tokio-postgres": "libpq", "mysqlclient-sys": "mysqlclient", "mysql": "mysqlclient", "libsqlite3-sys": "sqlite3", "gtk": "gtk4", "gtk4": "gtk4", "gdk": "gtk4", "gdk-pixbuf": "gtk4", "cairo-rs": "gtk4", "pango": "gtk4", "glib": "gtk4", "gio": "gtk4", "zmq": "zeromq", "curl": "libcurl", "curl-sys": "libcurl", "libgit2-sys": "libgit2", "git2": "libgit2"}
# Traits that can be derived, error codes about imports, stages with their percentage.
DERIVABLE = ("Debug", "Clone", "PartialEq", "Eq", "Hash", "Default", "PartialOrd", "Ord")
IMPORT_CODES = ("E0432", "E0433", "E0405", "E0412")
STAGES = {"Idle": 0, "Parsing": 5, "Scaffolding": 10, "Translating": 15, "Verifying": 70, "Optimizing": 88, "Completed": 100}

# What begins a symbol's line, by language; longer beginnings come before their parts.
PYTHON_BEGINS = ("async def ", "def ", "class ")
SCRIPT_BEGINS = ("export async function ", "export function ", "async function ", "function ", "export class ", "class ", "export const ", "export let ", "export default function ", "export default class ", "export type ", "export interface ", "const ", "let ")
GO_BEGINS = ("func ", "type ", "var ", "const ")
RUBY_BEGINS = ("def ", "class ", "module ")
NO_DECLARATION = ("import ", "package ", "using ", "namespace ")
# What a log says of a dependency that can't be resolved, and marks of generated files.
UNRESOLVED = ("failed to select a version", "no matching package", "failed to load source for dependency", "searched package name")
UNFETCHED = ("failed to get", "dependency")
STUB_MARK, FAILED_MARKS = "// [STUB] Skipped", ("translation failed for chunk", "run aborted before this file", "// read error:")
# Kinds of public declarations.
PUBLIC_KINDS = ("fn", "async fn", "struct", "enum", "trait", "type", "const", "static", "mod", "impl")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def language(path: Column) -> Column:
    """The language of a file by its extension, or null."""
    return F.element_at(_map(LANGUAGES), T.extension(path))


def display(lang: Column) -> Column:
    return F.coalesce(F.element_at(_map(DISPLAY), lang), lang)


def dynamic(lang: Column) -> Column:
    return lang.isin(*DYNAMIC)


def is_entry(path: Column, lang: Column) -> Column:
    """A file whose stem starts a program in its language."""
    name = F.lower(T.stem(path))
    rule = F.lit(False)
    out = F.when(F.lit(False), rule)
    for key, stems in ENTRY_STEMS.items():
        out = out.when(lang == key, name.isin(*stems))
    return out.otherwise(name == "main")


def imported(line: Column, lang: Column) -> Column:
    """What a line imports in its language; null for other lines."""
    filled = lambda x: F.when(x != "", x)
    python = filled(F.regexp_extract(line, "^(?:import|from) +(\\S+)", 1))
    script = F.when(line.contains("require(") | line.startswith("import "), filled(F.regexp_extract(line, "[\"']([^\"']*)[\"']", 1)))
    go = filled(F.regexp_extract(line, '^"+([^"]+)"+$', 1))
    c = filled(F.regexp_extract(line, '^#include\\s*"([^"]*)"', 1))
    return F.when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).when(lang == "go", go).when(lang.isin("c", "cpp"), c)


def imports(files: DataFrame, most: int = 100) -> DataFrame:
    """Imports in the first lines of files (path, lang, content): path, lang, line_no, symbol."""
    head = F.slice(T.lines(F.col("content")), 1, most)
    at = files.select("path", "lang", F.posexplode(head).alias("line_no", "line"))
    return at.select("path", "lang", "line_no", imported(F.trim("line"), F.col("lang")).alias("symbol")).filter("symbol is not null")


def level_rank(level: Column) -> Column:
    """Severity from 0 (help) to 4 (internal error); unknown levels rank as notes."""
    return F.coalesce(F.element_at(_map(LEVELS), level), F.lit(1))


def _any(message: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [message.contains(w) for w in words])


def family(code: Column, message: Column) -> Column:
    """The family of a diagnostic: by code with the message's help, else by message, else Other."""
    m = F.lower(F.coalesce(message, F.lit("")))
    by_code = F.element_at(_map({c: f for f, codes in CODES.items() for c in codes}), code)
    for name, (other, words) in REFINED.items():
        by_code = F.when((by_code == name) & _any(m, words), other).otherwise(by_code)
    by_text = F.lit("Other")
    for name, rules in reversed(MESSAGES):
        holds = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [m.contains(w) for w in words]) for words in rules])
        by_text = F.when(holds, name).otherwise(by_text)
    return F.coalesce(by_code, by_text)


def family_detail(code: Column, name: Column) -> Column:
    """The code of a diagnostic in no family, `unknown` without one; null in a family."""
    return F.when(name == "Other", F.coalesce(code, F.lit("unknown")))


def families(spark: SparkSession) -> DataFrame:
    """Family, priority, auto_fixable: 13 rows."""
    return spark.createDataFrame(list(FAMILIES), "family string, priority int, auto_fixable boolean")


def errors(diags: DataFrame) -> DataFrame:
    """Diagnostics from error level on."""
    return diags.filter(level_rank(F.col("level")) >= 3)


def ranked_families(diags: DataFrame) -> DataFrame:
    """Error families by what to repair first: family, priority, count, rank."""
    counts = errors(diags).groupBy(family(F.col("code"), F.col("message")).alias("family")).agg(F.count("*").alias("count"))
    order = Window.orderBy(F.desc("priority"), F.desc("count"), "family")  # at most 13 rows
    return counts.join(F.broadcast(families(diags.sparkSession)), "family").withColumn("rank", F.row_number().over(order)).select("family", "priority", "count", "rank")


def _ends(name: Column, ends: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(e) for e in ends])


# Names, folders and marks of files that aren't translated.
TEST_ENDS = ("_test.go", "_test.py", ".test.ts", ".test.js", ".spec.ts", ".spec.js")
TEST_NAMES = ("tests.py", "test.py")
TEST_FOLDERS = ("test", "tests", "testdata", "__tests__", "test-support", "e2e", "fixtures", "mocks", "mock", "stubs", "fakes", "fake")
GENERATED_ENDS = (".generated.ts", ".generated.js", ".generated.py", ".gen.go", ".pb.go", "_pb2.py", "_grpc.py", ".g.dart")
GENERATED_MARKS = ("DO NOT EDIT", "Code generated", "AUTO-GENERATED", "@generated", "autogenerated", "// AUTOGENERATED", "# AUTOGENERATED")


def stub_reason(path: Column, content: Column) -> Column:
    """Why a file is only stubbed, first rule that holds; null if it isn't."""
    name, where, text = F.lower(T.file_name(path)), F.lower(path), T.strip(content)
    head = F.left(text, F.lit(500))
    return (
        F.when(F.octet_length(text) < 16, "empty file")
        .when(name.startswith("test_") | _ends(name, TEST_ENDS) | name.isin(*TEST_NAMES), "test file")
        .when(where.rlike("/(" + "|".join(TEST_FOLDERS) + ")/"), "test/fixture path")
        .when(_ends(name, GENERATED_ENDS), "generated file")
        .when(_any(head, GENERATED_MARKS), "auto-generated (header marker)")
        .when(name.isin("setup.py", "setup.cfg") & (F.octet_length(text) < 300), "trivial config")
    )


def tier(tokens: Column, fast: int = 400, mid: int = 3000) -> Column:
    return F.when(tokens < fast, "fast").when(tokens < mid, "mid").otherwise("full")


def native_library(package: Column) -> Column:
    """The native library that a package needs: by name, or unknown for a name in -sys; else null."""
    name = F.lower(package)
    return F.coalesce(F.element_at(_map(NATIVE), name), F.when(name.endswith("-sys"), F.lit("unknown")))


def not_import(code: Column) -> Column:
    """Not about imports; diagnostics without a code stay."""
    return code.isNull() | ~code.isin(*IMPORT_CODES)


def confined(path: Column, root: str = "src") -> Column:
    """Below a folder by segments, and never going up."""
    return path.startswith(root + "/") & ~F.exists(F.split(path, "/"), lambda s: s == "..")


def same_suffix(a: Column, b: Column) -> Column:
    """One path ends with the other, whatever the separators."""
    x, y = F.translate(a, "\\", "/"), F.translate(b, "\\", "/")
    return (x == y) | x.endswith(y) | y.endswith(x)


def output_state(text: Column, skipped: str = STUB_MARK, failed: tuple[str, ...] = FAILED_MARKS) -> Column:
    """stub, failed or ok; stub wins."""
    return F.when(text.contains(skipped), "stub").when(_any(text, failed), "failed").otherwise("ok")


def occurrences(text: Column, piece: str) -> Column:
    """How often a piece occurs in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("bigint")


def outcome(clean: Column, failed: Column) -> Column:
    """Verdict of a run: not run, pipeline failed, clean or partial."""
    return F.when(clean.isNull() & failed.isNull(), "not run").when(F.coalesce(failed, F.lit(False)), "pipeline failed").when(clean, "clean").otherwise("partial")


def unresolvable(log: DataFrame) -> DataFrame:
    """Names of dependencies that a log says can't be resolved: run_id, name."""
    l = F.lower("line")  # noqa: E741
    says = _any(l, UNRESOLVED) | (l.contains(UNFETCHED[0]) & l.contains(UNFETCHED[1]))
    name = F.trim(F.regexp_extract(T.between_backticks(F.col("line")), "^([^= ]*)", 1))
    return log.filter(says).select("run_id", name.alias("name")).filter("name <> ''").distinct()


def commented_out(lines: DataFrame, names: DataFrame, mark: str = "# removed: ") -> DataFrame:
    """Manifest lines (file, pos, line) with those that set one of the names made comments."""
    own = F.trim(F.substring_index("line", "=", 1))
    return lines.withColumn("_name", own).join(names.select(F.col("name").alias("_name"), F.lit(True).alias("_gone")).distinct(), "_name", "left").select("file", "pos", F.when(F.col("_gone") & F.col("line").contains("="), F.concat(F.lit(mark), "line")).otherwise(F.col("line")).alias("line"))


def declares_public(line: Column) -> Column:
    return F.trim(line).rlike(f"^pub ({'|'.join(PUBLIC_KINDS)}) ")


def boundary(line: Column, lang: Column) -> Column:
    """The symbol that a line begins in its language; null for other lines."""
    t = F.trim(line)
    filled = lambda x: F.when(x != "", x)
    after = lambda begins, rest: f"^(?:{'|'.join(begins)}){rest}"
    python = F.when(t.rlike(after(PYTHON_BEGINS, "")), F.trim(F.regexp_replace(F.regexp_extract(t, after(PYTHON_BEGINS, "([^(]*)"), 1), ":+$", ""))).when(t.rlike("^\\p{Lu}") & t.contains("="), F.trim(F.substring_index(t, "=", 1)))
    script = filled(F.trim(F.regexp_extract(t, after(SCRIPT_BEGINS, "([^(<= ]*)"), 1)))
    go = F.when(t.rlike(after(GO_BEGINS, "")), F.trim(F.regexp_extract(t, after(GO_BEGINS, "([^( ]*)"), 1)))
    flush = ~line.rlike("^[ \\t]") & (t != "") & ~t.startswith("//")
    java = F.when(flush & ~t.rlike(after(NO_DECLARATION, "")) & (t.rlike("class |interface |enum ") | (t.contains("(") & t.contains(")") & ~t.contains(";"))), F.coalesce(F.get(F.filter(F.split(t, "\\s+"), lambda w: w.rlike("^\\p{L}") & ~w.contains("(")), F.lit(0)), F.lit("?")))
    c = F.when(flush & ~t.startswith("#") & ~t.startswith("typedef") & (t.contains("(") | t.rlike("^(struct|class|enum) ")), F.coalesce(F.get(F.filter(F.split(t, "[( ]"), lambda w: w.rlike("^[\\p{L}\\p{N}_]+$")), F.lit(0)), F.lit("?")))
    ruby = F.when(t.rlike(after(RUBY_BEGINS, "")), F.regexp_extract(t, after(RUBY_BEGINS, " *(\\S+)"), 1))
    return F.when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).when(lang == "go", go).when(lang.isin("java", "csharp"), java).when(lang.isin("c", "cpp"), c).when(lang == "ruby", ruby)


def acceptable(old: Column, new: Column) -> Column:
    """A regenerated set of names may lose a tenth of the old ones at most, and not all."""
    lost = F.size(F.array_except(old, new))
    return (F.size(old) == 0) | ((F.size(new) > 0) & (lost * 10 <= F.size(old)))


def stage_percent(stage: Column) -> Column:
    return F.coalesce(F.element_at(_map(STAGES), stage), F.lit(50))


def manifest_has(manifest: Column, package: Column) -> Column:
    """A manifest's text mentions a package, with dashes or underscores."""
    return F.when(manifest.contains(package) | manifest.contains(F.replace(package, F.lit("-"), F.lit("_"))), "declared").otherwise("MISSING")


def card(entries: DataFrame) -> DataFrame:
    """History entries (id, bytes, lang) as shown: size in KB, bar from 6 to 100 percent, language."""
    kb, bar = F.round(F.col("bytes") / 1024, 1), F.least(F.lit(100), F.greatest(F.lit(6), F.round(F.col("bytes") / 200000 * 100)))
    return entries.select("id", kb.alias("kb"), bar.cast("bigint").alias("bar"), F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.lit("rust")).alias("lang"))
