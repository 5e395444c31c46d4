"""Lexers over texts that are cut anywhere: blocks of declarations, statements, heads of paths.

A text is cut into chunks, and chunks are sorted into parts over the cluster, so one large text spreads over
tasks. A part is read once from every state that may come in, which tells how states go on; the states are
put together in order, and then each part is read once more from the right one (`scan.two_pass`). States
are few, but for a depth of brackets: what a part does with a depth depends on how far it falls below it.

What is found may lie in several chunks: it comes out in pieces, which are joined by their number.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.operators import classify as C
from millrace.operators import scan

#: Characters of a chunk, about.
CHUNK = 1 << 16

BEGINS = tuple(f"pub {kind} " for kind in C.PUBLIC_KINDS)
FUNCTIONS = ("pub fn ", "pub async fn ")


def cut_text(text: str, size: int, after: str) -> Iterator[tuple[str, str]]:
    """Chunks of a text with the two characters that follow each. A chunk of at least `size` ends after a match of `after`."""
    ends, at = re.compile(after), 0
    while at < len(text):
        m = ends.search(text, at + size - 1)
        end = m.end() if m else len(text)
        yield text[at:end], text[end : end + 2]
        at = end


def chunked(files: DataFrame, key: str, text: str, size: int, after: str) -> DataFrame:
    """Placed chunks (key, n, chunk, ahead) of texts; null and empty texts have none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, chunks, ahead = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (chunk, more) in enumerate(cut_text(t or "", size, after)):
                    rows.append(i)
                    n.append(k)
                    chunks.append(chunk)
                    ahead.append(more)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(chunks, pa.string()), pa.array(ahead, pa.string())], [key, "n", "chunk", "ahead"])

    schema = StructType([files.schema[key], StructField("n", LongType()), StructField("chunk", StringType()), StructField("ahead", StringType())])
    return scan.placed(files.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(split, schema), [key], ["n"])


def lexing(start: object, told: Callable[[list[tuple[str, str]]], object], goes: Callable[[object, object], object], read: Callable[[list[tuple[str, str]], object], tuple[list[tuple], object]], out: list[tuple[str, pa.DataType]]) -> scan.Machine:
    """A machine over chunks (key, n, chunk, ahead, ...) of texts.

    `start` is the state that a text begins in; `told` sums up chunks for any state, `goes` gives the state after
    them, and `read` gives what chunks hold, read from a state, and the state after them.
    """

    def texts(part: pa.Table) -> list[tuple[int, int, bool]]:
        """From and to which row a text goes, and whether it begins here."""
        n = part.column("n").to_pylist()
        first = [0] + [i for i in range(1, len(n)) if n[i] == 0]
        return [(a, b, n[a] == 0) for a, b in zip(first, [*first[1:], len(n)], strict=True)]

    def rows(part: pa.Table, a: int, b: int) -> list[tuple[str, str]]:
        return list(zip(part.column("chunk").slice(a, b - a).to_pylist(), part.column("ahead").slice(a, b - a).to_pylist(), strict=True))

    def summary(part: pa.Table) -> bytes:
        found = texts(part)
        a, b, begins = found[-1]
        if begins:
            return pickle.dumps((True, read(rows(part, a, b), start)[1]))
        return pickle.dumps((False, told(rows(part, a, b))))

    def carry(state: bytes | None, summed: bytes) -> bytes:
        known, what = pickle.loads(summed)
        return pickle.dumps(what if known else goes(pickle.loads(state), what))

    def apply(part: pa.Table, state: bytes | None) -> pa.Table:
        at, found = [], []
        for a, b, begins in texts(part):
            got, _ = read(rows(part, a, b), start if begins else pickle.loads(state))
            at += [a] * len(got)
            found += got
        keys = part.column(0).take(pa.array(at, pa.int64()))
        place = part.column(scan.AT).take(pa.array(at, pa.int64()))
        order = pa.array(range(len(found)), pa.int64())
        return pa.table([keys, place, order, *[pa.array([x[k] for x in found], kind) for k, (_, kind) in enumerate(out)]], names=[part.column_names[0], scan.AT, "piece", *[name for name, _ in out]])

    return scan.Machine(summary, carry, apply)


# -- statements ---------------------------------------------------------------------------------------------

#: Where a statement lexer can be: in code, a string, a character, or there with the next character escaped.
MODES = ("code", "string", "char", "string\\", "char\\")
STOPS = {"code": re.compile("[\"'{};]"), "string": re.compile(r'["\\]'), "char": re.compile(r"['\\]")}


def _statement_marks(chunks: list[tuple[str, str]], mode: str) -> tuple[list[tuple[int, int, str]], str]:
    """Brackets and semicolons of code (chunk, place, mark) from a mode on, and the mode after."""
    marks = []
    for i, (text, ahead) in enumerate(chunks):
        at, n = 0, len(text)
        while at < n:
            if mode[-1] == "\\":
                mode, at = mode[:-1], at + 1
                continue
            m = STOPS[mode].search(text, at)
            if m is None:
                break
            c, at = m[0], m.end()
            if c == "\\":
                if at < n or ahead:
                    mode += "\\"
            elif mode != "code":
                mode = "code"
            elif c == '"':
                mode = "string"
            elif c == "'":
                more = text[at : at + 2] + ahead[: max(0, at + 2 - n)]
                if more[:1] == "\\" or more[1:2] == "'":
                    mode = "char"
            else:
                marks.append((i, at - 1, c))
    return marks, mode


def _statement_told(chunks: list[tuple[str, str]]) -> dict:
    """By mode: the mode after, how far the depth changes, and how many semicolons there are at each depth from the first."""
    found = {}
    for mode in MODES:
        marks, after = _statement_marks(chunks, mode)
        depth, ends = 0, Counter()
        for _, _, c in marks:
            if c == ";":
                ends[depth] += 1
            else:
                depth += 1 if c == "{" else -1
        found[mode] = after, depth, ends
    return found


def _statement_goes(state: tuple[str, int, int], told: dict) -> tuple[str, int, int]:
    mode, depth, n = state
    after, change, ends = told[mode]
    return after, depth + change, n + ends[-depth]


def _statement_read(chunks: list[tuple[str, str]], state: tuple[str, int, int]) -> tuple[list[tuple], tuple[str, int, int]]:
    """Pieces (statement, text) of chunks."""
    mode, depth, n = state
    marks, after = _statement_marks(chunks, mode)
    out, i, at = [], 0, 0
    for k, place, c in marks:
        if c != ";":
            depth += 1 if c == "{" else -1
        elif depth == 0:
            while i < k:
                out.append((n, chunks[i][0][at:]))
                i, at = i + 1, 0
            out.append((n, chunks[i][0][at:place]))
            n, at = n + 1, place + 1
    out += [(n, t[at if j == 0 else 0 :]) for j, (t, _) in enumerate(chunks[i:])]
    return out, (after, depth, n)


def statement_machine() -> scan.Machine:
    return lexing(("code", 0, 0), _statement_told, _statement_goes, _statement_read, [("statement", pa.int64()), ("text", pa.string())])


def statements(files: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """Statements of texts: key, statement, its number from 0, and text, trimmed, without its semicolon.

    A text is split at `;` outside of braces, strings and characters; what a string or brace leaves open goes
    on to the end, and a brace closed too often closes all that follows. Blank statements are left out but
    counted. Null and empty texts have none; keys must be one for each text.
    """
    chunks = chunked(files, key, text, size, "(?s:.)")
    schema = StructType([chunks.schema[0], StructField(scan.AT, LongType()), StructField("piece", LongType()), StructField("statement", LongType()), StructField("text", StringType())])
    return _joined(scan.two_pass(chunks, statement_machine(), schema), key, "statement").withColumn("text", _trimmed(F.col("text"))).filter("text <> ''")


def stubs(found: DataFrame) -> DataFrame:
    """Statements as they stand in a skeleton: functions get a body that is to do, others their semicolon back."""
    function = F.col("text").rlike("^(pub )?(async )?fn ")
    return found.withColumn("text", F.when(function, F.concat("text", F.lit(" { todo!() }"))).otherwise(F.concat("text", F.lit(";"))))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _joined(pieces: DataFrame, key: str, number: str, *more: str) -> DataFrame:
    """Pieces of one number put together: key, number, text and the largest of further columns."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(scan.AT, "piece", "text"))), lambda p: p.text), "")
    return pieces.groupBy(key, number).agg(whole.alias("text"), *[F.max(m).alias(m) for m in more])


# -- blocks of declarations ---------------------------------------------------------------------------------


def _lines(chunks: list[tuple[str, str]]) -> list[str]:
    """Lines of chunks that end with lines, each with its end."""
    return [x for text, _ in chunks for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


class _Braces:
    """Lines by what a block does with them: where depth stands after each closing brace at the least, and at the end."""

    def __init__(self, lines: list[str]):
        self.lines, depth = lines, 0
        self.least, self.after, self.semicolon, self.begins = [], [], [], []
        for line in lines:
            least = None
            if "}" in line:
                for c in re.findall("[{}]", line):
                    depth += 1 if c == "{" else -1
                    if c == "}" and (least is None or depth < least):
                        least = depth
            else:
                depth += line.count("{")
            bare = line.strip()
            self.least.append(least)
            self.after.append(depth)
            self.semicolon.append(bare.endswith(";"))
            self.begins.append(bare.startswith(BEGINS))
        self.memo: dict[int, tuple] = {}
        self.next = [len(lines)] * (len(lines) + 1)
        for i in range(len(lines) - 1, -1, -1):
            self.next[i] = i if self.begins[i] else self.next[i + 1]

    def close(self, line: int, base: int) -> int | None:
        """The line from `line` on at which a block with its braces at `base` ends."""
        for i in range(line, len(self.lines)):
            if (self.least[i] is not None and self.least[i] <= base) or (self.semicolon[i] and self.after[i] == base):
                return i
        return None

    def outside(self, line: int) -> tuple:
        """The state after the last line, and how many blocks have begun, from outside of any block before a line."""
        way, n = [], len(self.lines)
        while (start := self.next[line]) < n and start not in self.memo:
            base = self.after[start - 1] if start else 0
            end = self.close(start, base)
            if end is None:
                self.memo[start] = self.after[-1] - base, 1
                break
            way.append(start)
            line = end + 1
        depth, blocks = self.memo[start] if start < n else (None, 0)
        for w in reversed(way):
            blocks += 1
            self.memo[w] = depth, blocks
        return depth, blocks


def _block_told(chunks: list[tuple[str, str]]) -> tuple:
    """What any state comes to: by the depth that comes in (null: outside), as far as lines fall below it; and how deeper ones change."""
    b = _Braces(_lines(chunks))
    first: dict[int, int] = {}
    lowest = 1
    for i, (least, semicolon, after) in enumerate(zip(b.least, b.semicolon, b.after, strict=True)):
        if least is not None and least < lowest:
            for d in range(max(-least, 0), max(-lowest, -1), -1):
                first.setdefault(d, i)
            lowest = least
        if semicolon and after <= 0:
            first.setdefault(-after, i)
    # a block deeper than all that lines close stays open; a lower line closes all above it
    found = {d: b.outside(i + 1) for d, i in first.items()}
    return b.outside(0), found, b.after[-1] if b.lines else 0


def _block_goes(state: tuple, told: tuple) -> tuple:
    depth, n = state
    outside, found, change = told
    after, more = outside if depth is None else found.get(depth, (depth + change, 0))
    return after, n + more


def _block_read(chunks: list[tuple[str, str]], state: tuple) -> tuple[list[tuple], tuple]:
    """Pieces (block, text, and by what it is closed, if it is) of chunks."""
    depth, n = state
    out: list[tuple] = []
    for line in _lines(chunks):
        bare = line.strip()
        if depth is None:
            if not bare.startswith(BEGINS):
                continue
            depth, n = 0, n + 1
        end = None
        for c in re.findall("[{}]", line):
            depth += 1 if c == "{" else -1
            if c == "}" and depth <= 0:
                end = "brace"
                break
        if end is None and depth == 0 and bare.endswith(";"):
            end = "semicolon"
        out.append((n - 1, line, end))
        if end:
            depth = None
    return out, (depth, n)


def block_machine() -> scan.Machine:
    return lexing((None, 0), _block_told, _block_goes, _block_read, [("block", pa.int64()), ("text", pa.string()), ("closed", pa.string())])


def declaration_blocks(files: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """Public declarations of texts: key, block, its number from 0, kind, decl and head.

    A block begins at a line that begins a declaration and ends with the line in which its braces close, or
    that ends with `;` outside of braces. kind is `fn` or `data`; decl is a function's signature up to its body
    and with a semicolon, or the lines as they are; head is the first line without what follows it. Blocks
    that never end, and signatures of nothing, are left out. Null and empty texts have no blocks.
    """
    chunks = chunked(files, key, text, size, "\n")
    schema = StructType([chunks.schema[0], StructField(scan.AT, LongType()), StructField("piece", LongType()), StructField("block", LongType()), StructField("text", StringType()), StructField("closed", StringType())])
    pieces = scan.two_pass(chunks, block_machine(), schema)
    whole = _joined(pieces, key, "block", "closed").filter("closed is not null")
    text = F.regexp_replace(F.regexp_replace("text", "\r?\n$", ""), "\r\n", "\n")
    first = _trimmed(F.substring_index(text, "\n", 1))
    function = F.startswith(_trimmed(text), F.lit(FUNCTIONS[0])) | F.startswith(_trimmed(text), F.lit(FUNCTIONS[1]))
    signature = F.concat(F.regexp_replace(_trimmed(F.substring_index(text, "{", 1)), ";+$", ""), F.lit(";"))
    head = F.when(F.col("closed") == "semicolon", F.regexp_replace(first, ";+$", "")).otherwise(_trimmed(F.regexp_replace(first, r"\{+$", "")))
    return whole.select(key, "block", F.when(function, "fn").otherwise("data").alias("kind"), F.when(function, signature).otherwise(text).alias("decl"), head.alias("head")).filter("decl <> ';'")


def contract_parts(blocks: DataFrame, key: str) -> DataFrame:
    """Per text with declarations: data, its data declarations with a blank line between, and signatures, a line each."""
    of = lambda kind, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("block", "decl")))), lambda b: b.decl), between)
    return blocks.groupBy(key).agg(of("data", "\n\n").alias("data"), of("fn", "\n").alias("signatures"))


# -- heads of paths -----------------------------------------------------------------------------------------

#: Where a path lexer can be: in code after a mark that no head follows or any other, or in one of these.
PLACES = ("code", "code:", "string", "char", "string\\", "char\\", "line", "block")
INSIDE = {"string": re.compile(r'["\\]'), "char": re.compile(r"['\\]"), "line": re.compile("\n"), "block": re.compile(r"\*/")}
CODE = re.compile(r"//|/\*|[\"']|(?P<name>[^\W\d]\w*)(?P<path>::)?|(?P<mark>\S)")


def _heads(chunks: list[tuple[str, str]], place: str) -> tuple[set[str], str]:
    """Heads of paths in code from a place on, and the place after. Chunks end after white space."""
    found = set()
    for text, ahead in chunks:
        at, n = 0, len(text)
        while at < n:
            if place[-1] == "\\":
                place, at = place[:-1], at + 1
            elif place in INSIDE:
                m = INSIDE[place].search(text, at)
                if m is None:
                    break
                at = m.end()
                if m[0] != "\\":
                    place = "code"
                elif at < n or ahead:
                    place += "\\"
            else:
                m = CODE.search(text, at)
                if m is None:
                    break
                at = m.end()
                if name := m["name"]:
                    if m["path"]:
                        at -= 2
                        if place == "code" and name[0].islower():
                            found.add(name)
                    place = "code"
                elif m[0] == "//":
                    place = "line"
                elif m[0] == "/*":
                    place = "block"
                elif m[0] == '"':
                    place = "string"
                elif m[0] == "'":
                    more = text[at : at + 2] + ahead[: max(0, at + 2 - n)]
                    place = "char" if more[:1] == "\\" or more[1:2] == "'" else "code"
                else:
                    place = "code:" if m["mark"] in ":." else "code"
    return found, place


def head_machine() -> scan.Machine:
    told = lambda chunks: {p: _heads(chunks, p)[1] for p in PLACES}

    def read(chunks: list[tuple[str, str]], place: str) -> tuple[list[tuple], str]:
        found, after = _heads(chunks, place)
        return [(x,) for x in sorted(found)], after

    return lexing("code", told, lambda place, t: t[place], read, [("head", pa.string())])


def crate_heads(files: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """Names in lower case that begin a path `a::b` in code, and those of `extern crate a;` lines: key, head, once each.

    Not those in strings, characters or comments, nor after `:` or `.`; the lines count wherever they are, with
    `-` as `_`. Null and empty texts have none.
    """
    chunks = chunked(files, key, text, size, r"\s")
    schema = StructType([chunks.schema[0], StructField(scan.AT, LongType()), StructField("piece", LongType()), StructField("head", StringType())])
    paths = scan.two_pass(chunks, head_machine(), schema).select(key, "head")
    lines = files.select(key, F.explode(F.split(F.col(text), "\n")).alias("line"))
    name = F.regexp_extract("line", r"^(?U:\s*)extern crate ([^; ]*)", 1)
    named = lines.select(key, F.replace(_trimmed(name), F.lit("-"), F.lit("_")).alias("head")).filter("head <> ''")
    return paths.unionByName(named).distinct()
