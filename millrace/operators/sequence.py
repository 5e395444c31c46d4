"""Operators over ordered lines: spans, bins, budgets, blocks, runs.

Windows are partitioned by file (or another key), so what a task holds is one file's lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from millrace.functions import text as T
from millrace.operators import classify as C
from millrace.operators import scan

#: Types as objects: a string would need a session to be parsed in.
STRINGS = ArrayType(StringType())
RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))

BUDGET = 5000


def spans(lines: DataFrame, key: str = "path") -> DataFrame:
    """Boundary lines (key, pos, line, lang) with the lines and tokens up to the next: key, pos, end, symbol, tokens."""
    at, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    sized = lines.withColumn("_symbol", C.boundary(F.col("line"), F.col("lang"))).withColumn("_before", F.sum(F.octet_length("line") + 1).over(at.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.max("pos").over(whole) + 1).withColumn("_all", F.sum(F.octet_length("line") + 1).over(whole))
    marks = sized.filter("_symbol is not null")
    # a span's lines joined by newlines have one byte less than its lines with one each
    size = F.lead("_before").over(at)
    return marks.select(key, "pos", F.coalesce(F.lead("pos").over(at), "_n").alias("end"), F.col("_symbol").alias("symbol"), F.ceil((F.coalesce(size, "_all") - F.coalesce("_before", F.lit(0)) - 1) / 4).cast("bigint").alias("tokens"))


def in_order(df: DataFrame, key: str, order: list[str], fold: Callable[[], Callable[[tuple], list[tuple]]], schema: StructType) -> DataFrame:
    """Rows that a fold gives for a key's rows in order; the fold begins anew at each key.

    A key's rows stream through one task, sorted; no task holds a key's rows at once. The fold takes a
    row as a tuple and gives the rows that are settled by it, and takes null after a key's last row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, now = None, None
        names, kinds = schema.names, to_arrow_schema(schema)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if step is None or row[0] != now:
                    if step is not None:
                        out += step(None)
                    step, now = fold(), row[0]
                out += step(row)
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema=kinds)
        if step is not None and (out := step(None)):
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema=kinds)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def line_blocks(lines: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """Blocks of a fixed number of lines: key, block, first, last, bytes."""
    n = max(50, budget * 4 // 80)
    return lines.groupBy(key, F.floor(F.col("pos") / n).cast("bigint").alias("block")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum(F.octet_length("line")).alias("bytes"))


def budgeted(blocks: DataFrame, key: str, order: str, text: str, budget: int, rule: str, group: str | None = None) -> DataFrame:
    """Blocks of each key in order within a byte budget: key, blocks, bytes.

    before: stops before the block that would overflow.
    after: stops after the block that reaches the budget; the whole is cut to it.
    cut: the block that would overflow is cut to fit.
    skip: the blocks of all groups of a key share the budget, in the order of groups; a block that
    does not leave the whole below the budget ends its group, and the next group goes on. Blocks that
    were taken are joined by one byte each.

    Running sums come from a prefix scan, so a key's blocks may be any number. For `skip` they leave of each
    group what fits the budget by itself, at most as many blocks with text as bytes; only that goes on in order.
    """
    keys = [key] if rule != "skip" else [key, group]
    sized = blocks.select(*keys, F.col(order).alias("_order"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("_size"))
    rows = scan.placed(sized, keys, ["_order"])
    if rule == "skip":
        total = scan.running(rows, keys, _sum=("sum", F.col("_size"))).filter(F.col("_sum") - F.col("_size") < budget)

        def fold():
            used, n, ended, name = 0, 0, object(), None

            def put(row):
                nonlocal used, n, ended, name
                if row is None:
                    return [(name, n, used)]
                name = row[0]
                if row[2] != ended:
                    if used + row[1] < budget:
                        used, n = used + row[1] + (used > 0), n + 1
                    else:
                        ended = row[2]
                return []

            return put

        few = total.select(key, "_size", F.col(group).alias("_group"), "_order")
        return in_order(few, key, ["_group", "_order"], fold, StructType([few.schema[0], StructField("blocks", LongType()), StructField("bytes", LongType())]))
    total = scan.running(rows, keys, _sum=("sum", F.col("_size")))
    if rule == "before":
        return total.filter(F.col("_sum") <= budget).groupBy(key).agg(F.count("*").alias("blocks"), F.sum("_size").alias("bytes"))
    if rule == "after":
        return total.filter(F.col("_sum") - F.col("_size") <= budget).groupBy(key).agg(F.count("*").alias("blocks"), F.least(F.sum("_size"), F.lit(budget)).alias("bytes"))
    if rule == "cut":
        return total.filter(F.col("_sum") - F.col("_size") < budget).groupBy(key).agg(F.count("*").alias("blocks"), F.least(F.sum("_size"), F.lit(budget)).alias("bytes"))
    raise ValueError(rule)


def joined(rows: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Per key: its texts in order, a line each, up to so many bytes; the one that would go beyond is cut.

    Every text takes a byte at least with its line's end, so no more than `most` first ones of a key
    are ever moved.
    """
    at = Window.partitionBy(key).orderBy(order)
    first = rows.select(key, F.col(order).alias("_order"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_order"))).filter(F.col("_rank") <= most)
    start = F.sum(F.octet_length("_text") + 1).over(at.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("_start", F.coalesce(start, F.lit(0))).filter(F.col("_start") < most)
    fits = F.when(F.col("_start") + F.octet_length("_text") <= most, F.col("_text")).otherwise(T.first_bytes(F.col("_text"), F.lit(most) - F.col("_start")))
    lines = F.array_sort(F.collect_list(F.struct("_order", fits.alias("line"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("text"))


def brace_blocks(files: DataFrame) -> DataFrame:
    """Public declarations of files (file, text), each up to where its braces close or to `;`: file, ord, kind, decl.

    kind is `fn` for functions, whose text is their signature, and `data` for all else.
    """

    begins = tuple(f"pub {kind} " for kind in C.PUBLIC_KINDS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"file": [], "ord": [], "kind": [], "decl": []}
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[str] = []
                depth, n = 0, 0
                for line in (text or "").splitlines():
                    bare = line.strip()
                    if not held and not bare.startswith(begins):
                        continue
                    function = (held[0] if held else bare).strip().startswith(("pub fn ", "pub async fn "))
                    cut, done = line, False
                    for k, c in enumerate(line):
                        depth += (c == "{") - (c == "}")
                        if (c == "{" and function and depth == 1) or (c == "}" and depth <= 0) or (c == ";" and depth == 0):
                            cut, done = line[: k if c == "{" else k + 1], True
                            break
                    held.append(cut.rstrip())
                    if done:
                        out["file"].append(file)
                        out["ord"].append(n)
                        out["kind"].append("fn" if function else "data")
                        out["decl"].append("\n".join(held).strip())
                        held, depth, n = [], 0, n + 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("decl", pa.string())]))

    return files.select("file", "text").mapInArrow(blocks, "file string, ord int, kind string, decl string")


def split_contract(blocks: DataFrame) -> DataFrame:
    """Per file: its data declarations and its function signatures, joined in order."""
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "decl")))), lambda x: x.decl), "\n")
    return blocks.groupBy("file").agg(joined("data").alias("data"), joined("fn").alias("signatures"))


@F.arrow_udf(STRINGS)
def statements(texts: pa.Array) -> pa.Array:
    """Statements of a text, split at `;` outside brackets, strings and characters."""
    out = []
    for t in texts.to_pylist():
        found, depth, start, quote, skip, t = [], 0, 0, "", False, t or ""
        for k, c in enumerate(t):
            if skip:
                skip = False
            elif quote:
                skip, quote = c == "\\", "" if c == quote else quote
            elif c == '"' or (c == "'" and t[k + 2 : k + 3] == "'") or (c == "'" and t[k + 1 : k + 2] == "\\"):
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ";" and depth <= 0:
                found.append(t[start : k + 1].strip())
                start = k + 1
        if t[start:].strip():
            found.append(t[start:].strip())
        out.append(found)
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(BooleanType())
def balanced(texts: pa.Array) -> pa.Array:
    """Whether a text could be parsed as code at all: brackets pair up, and strings and comments end."""
    token = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.[^']*|[^'\\])'|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<loose>"|/\*)""", re.S)
    pair, out = {")": "(", "]": "[", "}": "{"}, []
    for t in texts.to_pylist():
        held, good = [], True
        for m in token.finditer(t or ""):
            if m["open"]:
                held.append(m[0])
            elif m["close"]:
                good &= bool(held) and held.pop() == pair[m[0]]
            good &= not m["loose"]
        out.append(good and not held)
    return pa.array(out, pa.bool_())


def parse_gate(code: Column, path: Column) -> Column:
    """Code, or for code that can't be parsed a stub that says so, and whether it is a stub: code, stubbed."""
    good = balanced(code)
    stub = F.concat(F.lit("// TODO: no valid translation of `"), path, F.lit("`: the output was truncated or invalid and needs a manual port.\n"))
    return F.struct(F.when(good, F.coalesce(code, F.lit(""))).otherwise(stub).alias("code"), (~good).alias("stubbed"))


@F.arrow_udf(DoubleType())
def arithmetic(texts: pa.Array) -> pa.Array:
    """The value of an expression of numbers, + - * / ^ and brackets; null if it isn't one or divides by zero.

    ^ binds tightest and to the right, and takes the whole part of its right side; a minus before a
    number or bracket binds tighter still.
    """
    token = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|([-+*/^()]))")
    binds = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 3, "neg": 4}
    do = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": lambda a, b: a ** int(b)}

    def value(text: str) -> float | None:
        numbers: list[float] = []
        waiting: list[str] = []

        def settle() -> None:
            op = waiting.pop()
            last = numbers.pop()
            numbers.append(-last if op == "neg" else do[op](numbers.pop(), last))

        at, operand = 0, True
        while at < len(text.rstrip()):
            m = token.match(text, at)
            if m is None or (m[1] and not operand):
                return None
            at, op = m.end(), m[2]
            if m[1]:
                numbers.append(float(m[1]))
                operand = False
            elif op == "(" and operand:
                waiting.append(op)
            elif op == ")" and not operand:
                while waiting and waiting[-1] != "(":
                    settle()
                if not waiting:
                    return None
                waiting.pop()
            elif op == "-" and operand:
                waiting.append("neg")
            elif operand or op in "()":
                return None
            else:
                while waiting and waiting[-1] != "(" and (binds[waiting[-1]] > binds[op] or (binds[waiting[-1]] == binds[op] and op != "^")):
                    settle()
                waiting.append(op)
                operand = True
        if operand or "(" in waiting:
            return None
        while waiting:
            settle()
        return numbers[0]

    out = []
    for t in texts.to_pylist():
        try:
            out.append(value(t or ""))
        except (ArithmeticError, ValueError):
            out.append(None)
    return pa.array(out, pa.float64())


@F.arrow_udf(STRINGS)
def path_heads(texts: pa.Array) -> pa.Array:
    """Sorted first segments of paths `a::b` in code, not those in strings, characters or comments.

    A name is a head if `::` follows at once and neither `:` nor `.` is before it; inside the brackets of
    an import, names go on from its prefix and are none.
    """
    token = re.compile(r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>r#*".*?"#*|"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\.[^\']*|[^\'\\])\')|(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?P<path>(?=::))?|(?P<mark>\S)', re.S)
    out = []
    for t in texts.to_pylist():
        heads, before, depth = set(), "\n", -1  # depth of brackets in an import; -1 outside
        for m in token.finditer(t or ""):
            if m["name"]:
                if m["name"] == "use" and before in "\n;{}":
                    depth = 0
                if m["path"] is not None and before not in ":." and depth < 1:
                    heads.add(m["name"])
            elif m["mark"] and depth >= 0:
                depth = -1 if m["mark"] == ";" else depth + (m["mark"] == "{") - (m["mark"] == "}")
            before = m["mark"] or ("\n" if m["comment"] else "a")
        out.append(sorted(heads))
    return pa.array(out, pa.list_(pa.string()))


def _open_at_end(line: Column) -> Column:
    """Whether a line that begins outside a block comment ends inside one.

    What is read first counts: a line comment hides all after it, and block comments do not nest.
    """
    return F.regexp_replace(line, r"/\*.*?\*/|//.*", " ").contains("/*")


def in_comment(lines: DataFrame, key: str) -> DataFrame:
    """Lines with whether they begin inside a block comment.

    A line ends inside or outside, whatever it began as, or keeps the state, or turns it round (`/*/`).
    So a line's state is that after the last line that settles it, turned by each line that turns it.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    closed = F.locate("*/", line)
    outside, inside = _open_at_end(line), F.when(closed == 0, True).otherwise(_open_at_end(F.substring(line, closed + 2, F.length(line))))
    at = Window.partitionBy(key).orderBy("pos")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({"_out": outside, "_in": inside})
    marked = marked.withColumn("_turns", F.coalesce(F.sum((F.col("_out") & ~F.col("_in")).cast("int")).over(at), F.lit(0)))
    settles = F.when(F.col("_out") == F.col("_in"), F.struct("_out", "_turns"))
    marked = marked.withColumns({"_last": F.last(settles, ignorenulls=True).over(before), "_now": F.coalesce(F.last("_turns").over(before), F.lit(0))})
    state = F.coalesce(F.col("_last._out"), F.lit(False))
    turned = (F.col("_now") - F.coalesce(F.col("_last._turns"), F.lit(0))) % 2 == 1
    return marked.withColumn("inside", state != turned).drop("_out", "_in", "_turns", "_last", "_now")


def use_lines_once(lines: DataFrame, key: str) -> DataFrame:
    """Lines of which repeated imports are kept once, the first."""
    use = F.trim("line").startswith("use ")
    same = Window.partitionBy(key, F.trim("line")).orderBy("pos")
    return lines.withColumn("_rank", F.when(use, F.row_number().over(same)).otherwise(1)).filter("_rank = 1").drop("_rank")


def blank_runs_once(lines: DataFrame, key: str) -> DataFrame:
    """Lines of which runs of blank ones are one."""
    blank, at = F.trim("line") == "", Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("_again", blank & F.coalesce(F.lag(blank).over(at), F.lit(False))).filter("not _again").drop("_again")


def attribute_above(lines: DataFrame, key: str) -> DataFrame:
    """Lines with the nearest line above that isn't documentation: where an attribute would be."""
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("above", F.last(F.when(~F.trim("line").startswith("///"), F.trim("line")), ignorenulls=True).over(above))


def newest_first(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Rows with their place from 1 among their key's, the newest first; rows of one time stay in order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), order)))


def renumbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with their place from 0 among their key's, however many a key has."""
    rows = scan.placed(df, [key], [order])
    return scan.running(rows, [key], place=("sum", F.lit(1).cast("bigint"))).withColumn("place", F.col("place") - 1).drop(scan.PART, scan.AT)


@F.arrow_udf(RANGES)
def disjoint(edits: pa.Array) -> pa.Array:
    """Of ranges in order, those that overlap none taken before."""
    out = []
    for row in edits.to_pylist():
        taken: list[dict] = []
        for e in row or []:
            if all(e["end"] <= x["start"] or e["start"] >= x["end"] for x in taken):
                taken.append(e)
        out.append(taken)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


@F.arrow_udf(StringType())
def edited(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """Texts with byte ranges replaced, the last range first; ranges past the end or inside a character are left out."""
    out = []
    for t, row in zip(texts.to_pylist(), edits.to_pylist(), strict=True):
        data = (t or "").encode()
        for e in sorted(row or [], key=lambda e: -e["start"]):
            new = data[: e["start"]] + e["replacement"].encode() + data[e["end"] :]
            try:
                new.decode()
            except UnicodeDecodeError:
                continue
            if e["end"] <= len(data):
                data = new
        out.append(data.decode())
    return pa.array(out, pa.string())


def use_leaves(uses: DataFrame, key: str = "file", text: str = "use") -> DataFrame:
    """Leaf paths of import trees such as `a::{b, c::{d, e}}`: key, leaf."""

    @F.arrow_udf(STRINGS)
    def flat(texts: pa.Array) -> pa.Array:
        def leaves(tree: str, prefix: str) -> list[str]:
            tree = tree.strip()
            if "{" not in tree:
                return [prefix + tree] if tree else []
            head, rest = tree.split("{", 1)
            inner = rest[: rest.rindex("}")] if "}" in rest else rest
            parts, depth, start = [], 0, 0
            for k, c in enumerate(inner):
                depth += (c == "{") - (c == "}")
                if c == "," and not depth:
                    parts.append(inner[start:k])
                    start = k + 1
            return [x for p in [*parts, inner[start:]] for x in leaves(p, prefix + head.strip())]

        return pa.array([leaves(t.strip().removeprefix("pub ").removeprefix("use ").rstrip(";"), "") if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return uses.select(key, F.explode(flat(F.col(text))).alias("leaf"))


@F.arrow_udf(StringType())
def fnv1a(contents: pa.Array) -> pa.Array:
    """The 64-bit FNV-1a digest of a text's bytes in hex, for files that were fingerprinted with it."""
    out = []
    for t in contents.to_pylist():
        h = 14695981039346656037
        for b in (t or "").encode():
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        out.append(f"{h:016x}")
    return pa.array(out, pa.string())
