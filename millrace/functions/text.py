"""Column functions over source text, paths, names and versions; all run inside the JVM.

Each takes and returns columns, so Catalyst sees plain expressions. Lengths are bytes where the name
says so: budgets for text are byte budgets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are no dependency, or that every project has anyway.
RESERVED_DEPENDENCIES = ("std", "core", "alloc", "proc_macro", "test", "serde", "serde_json", "thiserror", "anyhow", "tokio", "reqwest", "tracing", "tracing-subscriber")

#: A call or path `head.member` or `head::member`, head starting in lower case at a word's begin.
SURFACE = "(?<![A-Za-z0-9_])[a-z][A-Za-z0-9_]*(?:\\.|::)[A-Za-z_][A-Za-z0-9_]*"


def api_surface(text: Column) -> Column:
    """Sorted distinct `head.member` symbols of a text; `::` counts as a dot."""
    found = F.regexp_extract_all(text, F.lit(SURFACE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.replace(s, F.lit("::"), F.lit(".")))))


def strip(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def tokens_up(text: Column) -> Column:
    """Estimated tokens, a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def tokens_down(text: Column) -> Column:
    """Estimated tokens, a quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def lexical_path(path: Column) -> Column:
    """A path without `.` and `..` segments, by its letters alone; `..` above the start is dropped."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")


def package_name(name: Column) -> Column:
    """A package name: lower case, other characters as `_`, never empty nor with a digit first."""
    safe = _plain(name)
    return F.when(F.regexp_replace(safe, "_", "") == "", F.lit("app")).when(safe.rlike("^[0-9]"), F.concat(F.lit("crate_"), safe)).otherwise(safe)


def project_name(path: Column) -> Column:
    """A project's name from its folder: as package_name, without outer `_`, `project_` before a digit."""
    safe = F.regexp_replace(_plain(F.element_at(F.split(path, "/"), -1)), "^_+|_+$", "")
    return F.when(safe == "", F.lit("project")).when(safe.rlike("^[0-9]"), F.concat(F.lit("project_"), safe)).otherwise(safe)


def identifier(name: Column) -> Column:
    """An identifier: as package_name, but `m_` before a digit and `module` for nothing."""
    safe = _plain(name)
    return F.when(safe == "", F.lit("module")).when(safe.rlike("^[0-9]"), F.concat(F.lit("m_"), safe)).otherwise(safe)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The extension in lower case; empty for none, or for a dot at the name's begin only."""
    return F.lower(F.regexp_extract(file_name(path), "^.+\\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(file_name(path), "^(.+)\\.[^.]*$", "$1")


HEADERS = ("h", "hpp", "hh", "hxx")


def flat_module(path: Column) -> Column:
    """One file name for a path: segments joined by `_`; headers keep `_h` apart from their source."""
    last = F.when(extension(path).isin(*HEADERS), F.concat(stem(path), F.lit("_h"))).otherwise(stem(path))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    joined = F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(last)), "_")
    safe = F.regexp_replace(F.lower(joined), "[^\\p{L}\\p{N}_]", "_")
    return F.concat(F.when(safe == "", F.lit("module")).when(safe.rlike("^[0-9]"), F.concat(F.lit("m_"), safe)).otherwise(safe), F.lit(".rs"))


def package_of(path: Column, by_folder: Column) -> Column:
    """The package of a file: its folder's name if languages namespace by folder, else its stem."""
    parts = F.split(path, "/")
    folder = identifier(F.element_at(parts, -2))
    own = F.when(extension(path).isin(*HEADERS), F.concat(identifier(stem(path)), F.lit("_h"))).otherwise(identifier(stem(path)))
    return F.when(by_folder & (F.size(parts) > 1), folder).otherwise(own)


def dependency_name(raw: Column) -> Column:
    """A dependency's name without quotes; null for what can't be one."""
    name = F.trim(F.regexp_replace(F.trim(raw), '^"+|"+$', ""))
    return F.when(name.rlike("^[A-Za-z][A-Za-z0-9_-]*$") & ~name.isin(*RESERVED_DEPENDENCIES), name)


def dependency_version(raw: Column) -> Column:
    """A version requirement without what follows it: `*`, or digits and dots after `^` or `~`."""
    v = F.trim(F.regexp_replace(F.trim(raw), '^"+|"+$', ""))
    found = F.regexp_extract(v, "^([\\^~]?[0-9]+(?:\\.[0-9]+)*)", 1)
    return F.when(v.startswith("*"), F.lit("*")).when(found != "", found)


def segment_key(segment: Column) -> Column:
    """A path segment as names are compared: lower case, without `_`."""
    return F.lower(F.replace(segment, F.lit("_"), F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two arrays of distinct elements; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def first_bytes(text: Column, most: int | Column) -> Column:
    """The longest prefix of whole characters with at most so many bytes.

    Cut as bytes; up to three bytes of a character that was cut in two are taken off again.
    """
    most = F.lit(most)
    cuts = [F.substring(F.encode(text, "UTF-8"), F.lit(1), F.greatest(F.lit(0), most - k).cast("int")).cast("string") for k in range(4)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts])
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def between_backticks(text: Column) -> Column:
    """What stands between the first two backticks; null if there aren't two."""
    return F.when(text.rlike("`[^`]*`"), F.regexp_extract(text, "`([^`]*)`", 1))


def backtick_words(text: Column) -> Column:
    """All non-empty pieces between backticks, a last one without its closing backtick included."""
    parts = F.split(text, "`")
    return F.filter(F.filter(parts, lambda x, i: i % 2 == 1), lambda x: x != "")


def trait_requests(message: Column) -> Column:
    """(type, trait) pairs that a message says are missing, in its two wordings."""
    first = F.struct(F.regexp_extract(message, "`([^`]*)` doesn't implement `([^`]*)`", 1).alias("type"), F.regexp_extract(message, "`([^`]*)` doesn't implement `([^`]*)`", 2).alias("trait"))
    inner = between_backticks(message)
    second = F.struct(F.trim(F.regexp_extract(inner, "^(.*?): (.*)$", 1)).alias("type"), F.trim(F.regexp_extract(inner, "^(.*?): (.*)$", 2)).alias("trait"))
    return F.array_compact(F.array(F.when(message.rlike("`[^`]*` doesn't implement `[^`]*`"), first), F.when(message.contains("the trait bound") & inner.contains(": "), second)))


def simple_type(type_: Column) -> Column:
    """The last segment of a plain path type without generics; null for other types."""
    last = F.trim(F.substring_index(F.trim(F.substring_index(type_, "<", 1)), "::", -1))
    return F.when(last.rlike("^[\\p{L}_][\\p{L}\\p{N}_]*$"), last)


def module_of(path: Column) -> Column:
    """The top module of a file under src/; null for the root files and for files elsewhere."""
    first = F.regexp_extract(path, "^src/([^/]*)", 1)
    name = F.regexp_replace(first, "\\.rs$", "")
    return F.when(~path.startswith("src/"), None).when(first.endswith(".rs"), F.when(~name.isin("main", "lib", "mod"), name)).otherwise(first)


def declared_name(signature: Column) -> Column:
    """The name that a public declaration declares; null if it has none."""
    rest = F.regexp_replace(signature, "^pub\\s+(?:async )?(?:fn |struct |enum |trait |type |const |static )?", "")
    name = F.regexp_extract(rest, "^([^(<: ]*)", 1)
    return F.when(name != "", name)


def strip_line_ends(text: Column) -> Column:
    """Lines without trailing white space and carriage returns; a last newline stays."""
    return F.regexp_replace(text, "[ \\t\\r]+(?=\\n|$)", "")


def canonical(text: Column) -> Column:
    """Lines trimmed and without blank ones; `k=True` and `k=False` in lower case."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")
    lower = lambda x: F.when(x.rlike("=(True|False)$"), F.concat(F.regexp_extract(x, "^(.*=)(True|False)$", 1), F.lower(F.regexp_extract(x, "^(.*=)(True|False)$", 2)))).otherwise(x)
    return F.array_join(F.transform(lines, lower), "\n")


def lines(text: Column) -> Column:
    """A text's lines: without line ends, and without an empty piece after the last one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\\r?\\n$", ""), "\\r?\\n"))


def without_fences(text: Column) -> Column:
    """What stands inside the first fenced block, or the trimmed text if there is none."""
    return F.when(text.rlike("(?s)```[^\\n]*\\n.*?```"), strip(F.regexp_extract(text, "(?s)```[^\\n]*\\n(.*?)```", 1))).otherwise(strip(text))


def first_filled(*choices: Column) -> Column:
    """The first choice that isn't null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in choices])


def percent_encoded(text: Column) -> Column:
    """Every byte as %XX but ASCII letters, digits and -_.~ (a space is %20)."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def expand(command: Column, folder: Column) -> Column:
    """The words of a command with {work} replaced."""
    return F.transform(command, lambda c: F.replace(c, F.lit("{work}"), folder))


def public_lines(text: Column) -> Column:
    """Top-level items made public, line by line; imports, implementations and macros stay."""
    return F.regexp_replace(text, "(?m)^(fn|async fn|struct|enum|trait|type|const|static|mod) ", "pub $1 ")
