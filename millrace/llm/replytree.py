r"""Conversations out of reply trees, formatted for training with a loss mask.

Every message names the message that it replies to. Self-joins enumerate the paths from root to leaf:
tables of each message's ancestor at distance 1, 2, 4, ... are made by joining the last one with
itself, and a path doubles with each of them, so a thread of a thousand turns takes ten joins. Branches
are ranked by the sum of their messages' scores, and each chosen path becomes one conversation.

The template:

    system      <<SYS>>\ntext\n<</SYS>>\n\n
    user        [INST] text [/INST]
    assistant   (space)text </s>
    any other   [ROLE role] text [/ROLE]

Control strings inside a text or role are escaped: a backslash is doubled, and the first character of
a control string becomes \l for < and \b for [, so that no control string is left. Reading back
undoes it. The loss mask covers assistant texts, without the marks around them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, written

CONTROL = re.compile(r"<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE|\[/ROLE\]")
ESCAPES = {"\\": "\\", "l": "<", "b": "[", "e": "]"}
TURN = re.compile(r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|\[ROLE (?P<role>.*?)\] (?P<other>.*?) \[/ROLE\]", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ("\\l" if m[0][0] == "<" else "\\b") + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES[m[1]], text, flags=re.S)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of it (in code points) that the loss counts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "system":
            part = f"<<SYS>>\n{body}\n<</SYS>>\n\n"
        elif role == "user":
            part = f"[INST] {body} [/INST]"
        elif role == "assistant":
            part = f" {body} </s>"
            spans.append((at + 1, at + 1 + len(body)))
        else:
            part = f"[ROLE {escape(role).replace(']', '\\e')}] {body} [/ROLE]"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        role = next(k for k in ("system", "user", "assistant", "other") if found[k] is not None)
        turns.append((unescape(found["role"]) if role == "other" else role, unescape(found[role])))
        at = found.end()
    return turns


def thread(conversations: DataFrame) -> DataFrame:
    """Messages of conversations kept as turns: each replies to the one before it.

    Turns are ordered by turn, then role and text; a null conv_id is one conversation like others.
    """
    tree = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), tree.alias("tree")).withColumn("node", F.row_number().over(order).cast("bigint")).select("conv_id", "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Per message of each chosen path: tree, leaf, branch (rank, from 1), depth (0 at the leaf), node.

    A message with a null tree or node is on no path; a null score adds nothing. An empty table gives
    no rows; other columns are not read.

    `messages` has tree, node (unique in its tree), parent (null at a root) and score, and is read
    several times. A message whose parent isn't there is a root; messages on a cycle are on no path.
    Branches of a tree are ranked by the sum of their scores, ties to the smaller leaf; the first
    `branches` are chosen, or all.
    """
    own = messages.select("tree", "node", "parent", "score")
    known = own.select("tree", F.col("node").alias("parent"))
    up = written(own.filter("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to"), "score"), "replies")
    leaves = own.join(up.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = written(leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("bigint").alias("depth"), "node"), "paths")
    step = 1
    jumps = up.select("tree", "node", "to")
    last, n = up, up.count()
    while n:
        above = found.join(jumps, ["tree", "node"]).select("tree", "leaf", (F.col("depth") + step).alias("depth"), F.col("to").alias("node"))
        longer = written(found.unionByName(above), "paths")
        discard(found)
        found = longer
        next_ = jumps.select("tree", F.col("node").alias("to"), F.col("to").alias("_to"))
        twice = written(jumps.join(next_, ["tree", "to"]).select("tree", "node", F.col("_to").alias("to")), "jumps")
        if last is not up:
            discard(last)
        left = twice.count()
        last, step = twice, step * 2
        jumps = twice.select("tree", "node", "to")
        if left == n:  # no message is that deep below a root: whatever is left leads round a cycle
            found = found.join(jumps.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti")
            break
        n = left
    scored = found.join(own.select("tree", "node", "score"), ["tree", "node"])
    total = scored.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    chosen = total.withColumn("branch", F.row_number().over(rank)).select("tree", "leaf", "branch")
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    return found.join(chosen, ["tree", "leaf"]).select("tree", "leaf", "branch", "depth", "node")


def conversations_of(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Per chosen path: tree, branch, n_turns, formatted (the text) and loss (spans that count).

    Null roles and texts are empty. An empty table gives no rows; other columns are not read.
    A path's messages meet in one row, since its text is one string; paths of one tree do not meet.
    """
    small_batches(messages.sparkSession)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths(messages, branches).join(said, ["tree", "node"])
    rows = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns"))

    @F.arrow_udf("struct<formatted: string, loss: array<struct<begin: bigint, end: bigint>>>")
    def form(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            done = [formatted(list(zip(r, t, strict=True))) for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
            yield pa.array([{"formatted": text, "loss": [{"begin": a, "end": b} for a, b in spans]} for text, spans in done], pa.struct([("formatted", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]))

    return rows.select("tree", "branch", F.size("turns").cast("bigint").alias("n_turns"), form("turns.role", "turns.text").alias("out")).select("tree", "branch", "n_turns", "out.*")


def digests(text: Column, loss: Column) -> Column:
    """What a formatted conversation holds, read back from its text and loss spans."""

    @F.arrow_udf("struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string, formatted_chars: bigint>")
    def digest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masks in batches:
            rows = []
            for t, spans in zip(texts.to_pylist(), masks.to_pylist(), strict=True):
                turns = read_back(t)
                counted = "".join(unescape(t[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(counted), hashlib.sha256(counted.encode()).hexdigest(), len(t)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return digest(text, loss)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All but the id are read back from the formatted text. Null texts and roles are empty; repeated
    turns are all kept; a null conv_id is one conversation. An empty table gives no rows; other
    columns are not read, so clashing names do not matter.
    """
    small_batches(conversations.sparkSession)
    messages = written(thread(conversations), "messages")
    ids = messages.filter("node = 1").select("tree", "conv_id")
    return conversations_of(messages).join(ids, "tree").select("conv_id", digests(F.col("formatted"), F.col("loss")).alias("d")).select("conv_id", "d.*")
