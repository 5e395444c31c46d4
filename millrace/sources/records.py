"""Line formats: JSON lines, compiler logs, manifests, Markdown, marked regions."""

from __future__ import annotations

import shlex
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions import text as T

#: Types as objects: a string would need a session to be parsed in.
STRINGS = ArrayType(StringType())

CORPUS = "source_lang string, source_api array<string>, source_code string, target_code string, package string, file string, tier string"
SPAN = "struct<file_name: string, line_start: bigint, line_end: bigint, column_start: bigint, column_end: bigint, byte_start: bigint, byte_end: bigint, is_primary: boolean, label: string, suggested_replacement: string, suggestion_applicability: string>"
MESSAGE = f"reason string, message struct<level: string, message: string, code: struct<code: string>, rendered: string, spans: array<{SPAN}>, children: array<struct<level: string, message: string, spans: array<{SPAN}>>>>"


def json_lines(lines: DataFrame, schema: str, required: list[str], value: str = "value") -> DataFrame:
    """Records of JSON lines; blank lines, lines that aren't JSON and records without a required field go."""
    found = lines.withColumn("_record", F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    for name in required:
        found = found.filter(F.col(f"_record.{name}").isNotNull())
    return found.select(*[c for c in lines.columns if c != value], "_record.*")


def read_json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """The same from files; a path that isn't there is an empty table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], schema)
    return json_lines(spark.read.text(path), schema, required)


def diagnostics(log: DataFrame) -> DataFrame:
    """Compiler messages of a log (run_id, line_no, value): level, code, message, spans.

    Other lines, JSON or not, are skipped; a missing level is a note; spans without a file or
    position are left out, not the message.
    """
    m = log.withColumn("_m", F.from_json("value", MESSAGE)).filter("_m.reason = 'compiler-message' and _m.message is not null")
    spans = F.filter("_m.message.spans", lambda s: s.file_name.isNotNull() & s.line_start.isNotNull() & s.byte_start.isNotNull())
    return m.select("run_id", "line_no", F.coalesce("_m.message.level", F.lit("note")).alias("level"), F.col("_m.message.code.code").alias("code"), F.coalesce("_m.message.message", F.lit("")).alias("message"), F.coalesce(spans, F.array()).alias("spans"))


def suggestions(log: DataFrame, accepted: list[str]) -> DataFrame:
    """Edits that a compiler proposes, from messages and their notes: file, start, end, replacement.

    Only suggestions of the accepted applicability; replacements that are placeholders are left out.
    """
    m = log.withColumn("_m", F.from_json("value", MESSAGE)).filter("_m.reason = 'compiler-message'")
    every = F.concat(F.coalesce("_m.message.spans", F.array()), F.coalesce(F.flatten(F.transform("_m.message.children", lambda c: F.coalesce(c.spans, F.array()))), F.array()))
    s = m.select("run_id", "line_no", F.posexplode(every).alias("pos", "s"))
    return s.filter(F.col("s.suggested_replacement").isNotNull() & F.col("s.suggestion_applicability").isin(*accepted) & real_replacement(F.col("s.suggested_replacement"))).select("run_id", "line_no", "pos", F.col("s.file_name").alias("file"), F.col("s.byte_start").alias("start"), F.col("s.byte_end").alias("end"), F.col("s.suggested_replacement").alias("replacement"))


def real_replacement(text: Column) -> Column:
    """Not a placeholder: no comment opener and no ellipsis."""
    return ~text.contains("/*") & ~text.contains("...")


def toml_rows(spark: SparkSession, text: str, table: str, schema: str) -> DataFrame:
    """The tables of one array in a TOML manifest, with nulls where a row lacks a field."""
    rows = tomllib.loads(text).get(table, [])
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def yaml_cases(spark: SparkSession, text: str, spec: str) -> DataFrame:
    """Cases of a YAML test specification with their defaults filled in."""
    import yaml

    found = yaml.safe_load(text) or {}
    compare = found.get("compare") or {}
    rows = []
    for case in found.get("cases") or []:
        own = case.get("compare") or {}
        rows.append((spec, case["name"], case.get("provenance", "manual"), [str(a) for a in case.get("args", [])], case.get("stdin"), {k: str(v) for k, v in (case.get("env") or {}).items()}, bool(case.get("nondeterministic", False)), *[own.get(k, compare.get(k, "exact")) for k in ("stdout", "stderr", "exit_code")]))
    return spark.createDataFrame(rows, "spec string, name string, provenance string, args array<string>, stdin string, env map<string,string>, nondeterministic boolean, cmp_stdout string, cmp_stderr string, cmp_exit string")


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with their position from 0: key, pos, line."""
    return docs.select(key, F.posexplode(T.lines(F.col(text))).alias("pos", "line"))


def fenced_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines inside ``` fences: key, pos, line."""
    fence = F.col("line").rlike("^\\s*```").cast("int")
    before = Window.partitionBy(key).orderBy("pos")
    return numbered(docs, key, text).withColumn("_fences", F.sum(fence).over(before)).filter((fence == 0) & (F.col("_fences") % 2 == 1)).drop("_fences")


@F.arrow_udf(STRINGS)
def shell_words(commands: pa.Array) -> pa.Array:
    """Words of a command as a shell would split it; null if quotes are open."""
    out = []
    for c in commands.to_pylist():
        try:
            out.append(shlex.split(c or ""))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.list_(pa.string()))


def mined_commands(docs: DataFrame, key: str = "doc_id", text: str = "text", binary: str = "binary") -> DataFrame:
    """Calls of a document's binary in its fenced blocks: key, ord, name, args; repeated calls once."""
    names = docs.select(key, binary)
    bare = F.regexp_replace(F.trim("line"), "^\\$ ", "")
    calls = fenced_lines(docs, key, text).join(names, key).select(key, "pos", binary, shell_words(bare).alias("w")).filter(F.col("w").isNotNull() & (F.get("w", F.lit(0)) == F.col(binary)))
    calls = calls.groupBy(key, F.expr("slice(w, 2, size(w))").alias("args")).agg(F.min("pos").alias("pos"))
    order = Window.partitionBy(key).orderBy("pos")
    return calls.withColumn("ord", F.row_number().over(order) - 1).select(key, "ord", F.concat(F.lit("readme_"), "ord").alias("name"), "args")


def regions(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Text between <<<src=P>>> and its end marker: key, path, body.

    A region that isn't ended goes on to the end of the text; regions with a blank body are left out.
    """
    begin, end = F.regexp_extract("line", "<<<src=(.+?)>>>", 1), F.col("line").contains("<<<end>>>")
    own = Window.partitionBy(key).orderBy("pos")
    marked = numbered(files, key, text).withColumn("_path", F.when(begin != "", begin)).withColumn("_region", F.count("_path").over(own))
    inside = Window.partitionBy(key, "_region").orderBy("pos")
    marked = marked.withColumn("_ended", F.max(end).over(inside)).withColumn("_name", F.first("_path", ignorenulls=True).over(inside))
    body = marked.filter("_region > 0 and not _ended and _path is null").groupBy(key, "_region", F.col("_name").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("body"))
    return body.filter(F.trim("body") != "").select(key, "path", "body")


def section_names(files: DataFrame, section: str, key: str = "file", text: str = "text") -> DataFrame:
    """Names that are set under one [section] of a manifest: key, name."""
    header = F.regexp_extract(F.trim("line"), "^\\[([^\\]]+)\\]", 1)
    own = Window.partitionBy(key).orderBy("pos")
    at = numbered(files, key, text).withColumn("_section", F.last(F.when(header != "", header), ignorenulls=True).over(own))
    name = F.trim(F.substring_index("line", "=", 1))
    return at.filter((F.col("_section") == section) & (header == "") & F.col("line").contains("=") & ~F.trim("line").startswith("#")).select(key, name.alias("name"))


def removed_names(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Names of dependencies that were commented out as removed: key, name."""
    name = F.regexp_extract("line", "^\\s*# removed(?: \\([^)]*\\))?: *([A-Za-z0-9_-]+)", 1)
    return numbered(files, key, text).select(key, name.alias("name")).filter("name <> ''")


def dependency_hints(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Dependencies noted as `// [DEPS] a = "1", b = "2"`: key, name, version; the last of a name wins."""
    rest = F.regexp_extract(F.trim("line"), "^// \\[DEPS\\](.*)$", 1)
    parts = numbered(files, key, text).filter(F.trim("line").startswith("// [DEPS]")).select(key, "pos", F.posexplode(F.split(rest, ",")).alias("at", "part")).filter(F.col("part").contains("="))
    cleaned = parts.select(key, "pos", "at", T.dependency_name(F.substring_index("part", "=", 1)).alias("name"), T.dependency_version(F.expr("substring(part, locate('=', part) + 1)")).alias("version"))
    return cleaned.filter("name is not null and version is not null").groupBy(key, "name").agg(F.max_by("version", F.struct("pos", "at")).alias("version"))


def last_json(lines: DataFrame, key: str = "run_id", order: str = "pos", value: str = "line") -> DataFrame:
    """Per key: the last line that is JSON."""
    return lines.filter(F.try_parse_json(F.col(value)).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias("json"))


@F.arrow_udf(StringType())
def first_object(texts: pa.Array) -> pa.Array:
    """The first balanced {...} of a text, a fenced block before others; null if there is none."""
    out = []
    for t in texts.to_pylist():
        t = t or ""
        if "```" in t:
            inside = t.split("```")[1]
            t = inside.split("\n", 1)[-1] + "\n" + t
        found, depth, start, quoted, skip = None, 0, -1, False, False
        for k, c in enumerate(t):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"' and depth:
                quoted = True
            elif c == "{":
                start = k if not depth else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    found = t[start : k + 1]
                    break
        out.append(found)
    return pa.array(out, pa.string())


def report_tier(report: Column) -> Column:
    """`behavior` if a JSON report says that it passed, else `compile`."""
    return F.when(F.coalesce(F.get_json_object(report, "$.passed") == "true", F.lit(False)), "behavior").otherwise("compile")


def with_help_case(cases: DataFrame) -> DataFrame:
    """Cases and, for each key, the constant one that asks for help: key, name, args."""
    key = cases.columns[0]
    more = cases.select(key).distinct().select(key, F.lit("help").alias("name"), F.array(F.lit("--help")).alias("args"))
    return cases.select(key, "name", "args").unionByName(more)


def harvested(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Regions of translated files joined with the sources they came from: path, source, target."""
    return regions(outputs).join(sources.select("path", F.col("content").alias("source")), "path").select("path", "source", F.col("body").alias("target"))

