"""Spelling variants against comparing all words, and on odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import variants


def lower(run):
    return "".join(c.lower() if c.isascii() else c for c in run)


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
            elif run:
                word = lower(run)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                n[word] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = plain_words(rows)
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, n, len(others), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {(w, f, root, n, k, fn) for w, (f, n, k, fn, root) in out.items()}


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabeéñ÷") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    base += [b[:3] + rng.choice("abeñ") + b[3:] for b in base] + [b[:2] + b[3:] for b in base] + ["Aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ÀÉaaaaa"]
    share = [rng.choice([1, 1, 2, 30]) for _ in base]
    return [(i, " ".join(rng.choices(base, share, k=rng.randint(0, 60))) + rng.choice(["", ",1x", "_é"])) for i in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_comparing_all(spark, seed):
    rows = [*texts(seed), (None, "abababab, abababab"), (70, None), (71, ""), (72, "日本" * 9)]
    rows += rows[:2]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    found = variants.variants(docs).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == plain(rows)
    assert len(found) == len({r["word"] for r in found}) and any(r["form"] for r in found)


def test_chain_of_forms(spark):
    """A form may be a variant itself; all lead to the same root."""
    chain = ["abcdefgh", "abcdefg", "xbcdefg", "xycdefg", "xyzdefg"]
    rows = [(k, " ".join([w] * 2 * 11 ** (len(chain) - i))) for k, (i, w) in enumerate(enumerate(chain[2:], 2))]
    rows += [(100 + i, " ".join([w] * 3 * 11 ** (4 - i))) for i, w in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.variants(docs).collect()}
    assert found == plain(rows) and max(len({x[1] for x in found}), 0) > 2


def test_empty_tables(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "1 2 3")], "doc_id long, text string")).count() == 0


def test_powers_have_no_equal_differences():
    """So that how two keys differ tells which letters were exchanged, and no pair meets twice."""
    codes = sorted({*b"abcdefghijklmnopqrstuvwxyz", *range(0xC0, 0x100)})
    away = [a**variants.POWER - b**variants.POWER for a in codes for b in codes if a != b] + [a**variants.POWER for a in codes]
    assert len(set(away)) == len(away)


def test_long_words_ask_like_short_ones():
    word = bytes(np.random.default_rng(1).integers(97, 105, 70).astype(np.uint8))
    def asked(short):
        old, variants.SHORT = variants.SHORT, short
        try:
            found = [np.stack([k, f.astype(np.uint64)]) for _, k, f in variants.keys([word])]
        finally:
            variants.SHORT = old
        return sorted(map(tuple, np.concatenate(found, 1).T.tolist()))
    assert asked(64) == asked(100) and len(asked(64)) <= 2 + 16


def test_letters_in_blocks(monkeypatch):
    words = [b"abcdefg", b"hello\xe9world", b"ab" * 60, b"aaaaaaa"]
    asked = lambda: [x.tolist() for found in variants.keys(words) for x in found]
    whole = asked()
    monkeypatch.setattr(variants, "BLOCK", 3)
    assert asked() == whole


def test_slices_and_parts(monkeypatch):
    """A text is split between runs, wherever a slice ends."""
    text = "abcdefg hijklmno éééééééé1aaaaaaaB x " * 50
    whole = variants.run_counts(variants.letters(text))
    monkeypatch.setattr(variants, "SLICE", 11)
    assert variants.run_counts(variants.letters(text)) == whole == Counter({b"abcdefg": 50, b"hijklmno": 50, "éééééééé".encode("latin-1"): 50, b"aaaaaaab": 50})


def test_no_words_go_through_the_driver(spark):
    """Compressed files of words look small, what they ask with isn't: no such table may be broadcast."""
    docs = spark.createDataFrame(texts(1), "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = variants.written(variants.word_counts(docs), "words")
    assert "Broadcast" not in plan(variants.near_pairs(words))
    assert "Broadcast" not in plan(variants.variants(docs))
