"""Lexers over cut texts against plain ones that read a text in one go."""

import random
import re

import pyarrow as pa
import pytest

from millrace.operators import lexers, scan

WORDS = ["a", "b::c", "std::io", "T::new", "x.y::z", '"', '\\"', "'", "'x'", "'\\''", "'a", "{", "}", "{", "}", ";", ";", "//", "/*", "*/", "\n", "\n", " ", "\\", "::", ":", "é::d", "pub fn f() ", "\npub struct S {", "\n  pub const N: u8 = 3;\n", "\npub fn g();", "}\n", "extern crate my-x;", "'\n'", "_p::q", "\r\n"]


def made(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 60)))


def plain_statements(text):
    found, now, mode, depth, i = [], "", "code", 0, 0
    while i < len(text):
        c = text[i]
        if mode != "code":
            if c == "\\" and i + 1 < len(text):
                now, i = now + text[i : i + 2], i + 2
                continue
            if c == mode:
                mode = "code"
        elif c == '"' or (c == "'" and (text[i + 2 : i + 3] == "'" or text[i + 1 : i + 2] == "\\")):
            mode = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
        elif c == ";" and depth == 0:
            found.append(now)
            now, i = "", i + 1
            continue
        now, i = now + c, i + 1
    return [(k, x.strip()) for k, x in enumerate([*found, now]) if x.strip()]


def plain_blocks(text):
    found, held, depth, n = [], None, 0, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.strip()
        if held is None:
            if not bare.startswith(lexers.BEGINS):
                continue
            held, depth = [], 0
        held.append(line)
        closed = False
        for c in line:
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth <= 0:
                    closed = True
                    break
        if closed or (depth == 0 and bare.endswith(";")):
            found.append((n, "".join(held)))
            held, n = None, n + 1
    return found


def plain_heads(text):
    found, mode, before, i = set(), "code", "\n", 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if mode == "code":
            if c == '"':
                mode, i = '"', i + 1
            elif two in ("//", "/*"):
                mode, i = two, i + 2
            elif c == "'":
                if text[i + 1 : i + 2] == "\\" or text[i + 2 : i + 3] == "'":
                    mode = "'"
                else:
                    before = "'"
                i += 1
            elif c == "_" or c.isalpha():
                j = i
                while j < len(text) and (text[j] == "_" or text[j].isalnum()):
                    j += 1
                if text[j : j + 2] == "::" and before not in ":." and c.islower():
                    found.add(text[i:j])
                before, i = text[j - 1], j
            else:
                before, i = c if not c.isspace() else before, i + 1
        elif mode in "\"'":
            if c == "\\" and i + 1 < len(text):
                i += 2
                continue
            if c == mode:
                mode, before = "code", c
            i += 1
        elif mode == "//":
            if c == "\n":
                mode, before = "code", c
            i += 1
        elif two == "*/":
            mode, before, i = "code", "/", i + 2
        else:
            i += 1
    return found


def cut_up(texts, size, after, rng):
    """Chunks of texts, cut into parts at random."""
    rows = [(k, n, chunk, ahead) for k, t in enumerate(texts) for n, (chunk, ahead) in enumerate(lexers.cut_text(t, size, after))]
    t = pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "chunk": [r[2] for r in rows], "ahead": [r[3] for r in rows], scan.AT: pa.array(range(len(rows)), pa.int64())})
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randint(0, 9)) if rows)})
    return [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def together(machine, texts, size, after, seed):
    parts = machine.alone(cut_up(texts, size, after, random.Random(seed)))
    return [r for p in parts for r in p.to_pylist()]


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_any_cut_gives_what_one_go_gives(size):
    for seed in range(250):
        texts = [made(seed * 10 + k) for k in range(4)]
        pieces = together(lexers.statement_machine(), texts, size, "(?s:.)", seed)
        found = {}
        for r in pieces:
            found[r["key"], r["statement"]] = found.get((r["key"], r["statement"]), "") + r["text"]
        assert sorted((k, n, t.strip()) for (k, n), t in found.items() if t.strip()) == [(k, n, t) for k, text in enumerate(texts) for n, t in plain_statements(text)], (seed, texts)

        pieces = together(lexers.block_machine(), texts, size, "\n", seed)
        found, closed = {}, set()
        for r in pieces:
            at = r["key"], r["block"]
            found[at] = found.get(at, "") + r["text"]
            closed |= {at} if r["closed"] else set()
        assert sorted((*at, t) for at, t in found.items() if at in closed) == [(k, n, t) for k, text in enumerate(texts) for n, t in plain_blocks(text)], (seed, texts)

        pieces = together(lexers.head_machine(), texts, size, r"\s", seed)
        assert {(r["key"], r["head"]) for r in pieces} == {(k, h) for k, text in enumerate(texts) for h in plain_heads(text)}, (seed, texts)


@pytest.fixture
def many_parts(spark):
    """Sorted tables in several parts, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_on_spark(spark, many_parts):
    texts = [made(k) for k in range(30)] + [None, "", "".join(made(k) for k in range(100, 160))]
    files = spark.createDataFrame(list(enumerate(texts)), "file long, text string").repartition(3)
    chunks = lexers.chunked(files, "file", "text", 20, "(?s:.)")
    assert chunks.select(scan.PART).distinct().count() > 1
    found = sorted((r["file"], r["statement"], r["text"]) for r in lexers.statements(files, "file", "text", 20).collect())
    assert found == [(k, n, t) for k, text in enumerate(texts) for n, t in plain_statements(text or "")]
    heads = {(r["file"], r["head"]) for r in lexers.crate_heads(files, "file", "text", 20).collect()}
    lines = {(k, m[1].strip().replace("-", "_")) for k, t in enumerate(texts) for x in (t or "").split("\n") if (m := re.match(r"\s*extern crate ([^; ]*)", x))}
    assert heads == {(k, h) for k, text in enumerate(texts) for h in plain_heads(text or "")} | lines
    blocks = lexers.declaration_blocks(files, "file", "text", 20).collect()
    want = {(k, n): t for k, text in enumerate(texts) for n, t in plain_blocks(text or "")}
    assert {(r["file"], r["block"]) for r in blocks} == set(want) and len(blocks) == len(want)
    for r in blocks:
        whole = want[r["file"], r["block"]].removesuffix("\n").removesuffix("\r").replace("\r\n", "\n")
        if r["kind"] == "data":
            assert r["decl"] == whole
        else:
            assert r["decl"] == whole.split("{")[0].strip().rstrip(";") + ";"


def test_stubs(spark):
    files = spark.createDataFrame([(1, "pub fn f() -> u8; pub const N: u8 = 1;; async fn g(); x")], "file long, text string")
    found = lexers.stubs(lexers.statements(files, "file", "text")).orderBy("statement").collect()
    assert [r["text"] for r in found] == ["pub fn f() -> u8 { todo!() }", "pub const N: u8 = 1;", "async fn g() { todo!() }", "x;"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "file long, text string")
    assert lexers.statements(none, "file", "text").count() == lexers.declaration_blocks(none, "file", "text").count() == lexers.crate_heads(none, "file", "text").count() == 0
