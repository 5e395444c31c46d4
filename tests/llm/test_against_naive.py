"""Operators that SQL can't express, against plain versions of the same rule."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as vocabularies

from millrace.llm import boost, dom, langid, maintext, packing, quality, replytree

DATA = "/root/testdata"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def naive_grams(text):
    """N-grams of 1 to 4 letters of each word with a boundary on both sides, as strings."""
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        found.update(word)
        found.update(padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1))
    return found


def naive_rank(found, size):
    order = lambda g: (len(g), [0 if c == " " else 1 + ord(c) % langid.SYMBOLS for c in g])
    return sorted(found, key=lambda g: (-found[g], order(g)))[:size]


def naive_predict(text, profiles, size):
    own = naive_rank(naive_grams(text), size)
    if not own:
        return "und"
    away = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
    return min(sorted(away), key=away.get)


TONGUES = {"el": "αβγδεζηθικ", "ru": "абвгдежзик", "en": "etaoinshrd", "de": "etaoinäöüß", "zh": "日本語中文字漢書話学"}


@pytest.mark.parametrize("size", [25, 400])
def test_languages_by_naive_out_of_place_distance(spark, size):
    r = random.Random(31)
    say = lambda t: " ".join("".join(r.choices(TONGUES[t], range(10, 0, -1), k=r.randint(1, 6))) for _ in range(r.randint(3, 40)))
    rows = [(k, t, say(t)) for k, t in enumerate(r.choices(sorted(TONGUES), k=160))]
    docs = spark.createDataFrame([(k, x, t) for k, t, x in rows], "doc_id bigint, text string, lang string").repartition(5)
    model = langid.learn(docs, size=size)
    import zlib

    totals = {}
    for k, t, x in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            totals.setdefault(t, Counter()).update(naive_grams(x))
    profiles = {t: naive_rank(c, size) for t, c in totals.items()}
    assert {t: len(p) for t, p in profiles.items()} == {t: int((model.place[:, j] >= 0).sum()) for j, t in enumerate(model.langs)}
    found = {v["doc_id"]: v["lang_pred"] for v in langid.identify(docs, model).collect()}
    assert found == {k: naive_predict(x, profiles, size) for k, _, x in rows}


def test_profiles_do_not_depend_on_where_rows_lie(spark):
    r = random.Random(32)
    rows = [(k, " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(30)), r.choice("xy")) for k in range(200)]
    one, many = (langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(n)) for n in (1, 17))
    assert one.langs == many.langs and (one.ids == many.ids).all() and (one.place == many.place).all()
    few = langid.learn(spark.createDataFrame(rows + [(1000 + k, "abc", f"dirty{k}") for k in range(50)], "doc_id bigint, text string, lang string"), langs=2)
    assert few.langs == ["x", "y"]


@tables
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_estimated_prior_is_near_the_labelled_share(spark, sf):
    docs, labels = (spark.read.parquet(f"{DATA}/{sf}/{x}.parquet") for x in ("documents", "labels"))
    share = labels.filter("quality is not null").agg({"quality": "avg"}).first()[0]
    assert abs(quality.learn(docs, labels).prior - share) < 0.05


def test_prior_of_few_rows():
    x = np.random.default_rng(33).normal(size=(50, 3))
    assert quality.class_prior(x[:1], x) == 0.5
    assert 0.01 <= quality.class_prior(x[:2], x[2:4]) <= 0.99


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_of_all_choices(seed):
    r = np.random.default_rng(seed)
    page = dom.Page("<div><p>a</p><ul><li>b<li>c</ul></div><section><p>d</p><div><p>e</p></div></section>")
    n = len(page.kind)
    odds = r.normal(size=n)
    keep = page.decode(odds)
    assert all(keep[page.parent[i]] or not keep[i] for i in range(1, n))
    worth = lambda chosen: sum(odds[i] for i in range(1, n) if chosen[i])
    every = ((True, *c) for c in itertools.product([False, True], repeat=n - 1))
    assert worth(keep) == pytest.approx(max(worth(c) for c in every if all(c[page.parent[i]] or not c[i] for i in range(1, n))))


def naive_pack(lengths, capacity):
    """Bins filled one after another over single documents, as the method says."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        while gap and bin_:
            small = min(bin_)
            pairs = [(a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= small + gap]
            if not pairs:
                break
            a, b = max(pairs, key=lambda p: (p[0] + p[1], p[0]))
            bin_.remove(small)
            left.append(small)
            for x in (a, b):
                left.remove(x)
            left.sort(reverse=True)
            bin_ += [a, b]
            gap += small - a - b
        bins.append(sorted(bin_, reverse=True))
    return bins


def test_packing_plan_equals_packing_one_by_one():
    r = random.Random(34)
    for _ in range(60):
        capacity = r.choice([10, 16, 30])
        lengths = [r.randint(1, capacity) if r.random() < 0.5 else r.randint(1, capacity // 3) for _ in range(r.randint(1, 50))]
        bins = packing.plan(dict(Counter(lengths)), capacity)
        assert sorted(x for b, n in bins for x in b * n) == sorted(lengths)
        assert sum(n for _, n in bins) == len(naive_pack(lengths, capacity))


def test_packed_offsets_are_gapless(spark):
    r = random.Random(35)
    texts = [None, "", *[" ".join("".join(r.choices("abcde", k=3)) for _ in range(r.randint(1, 400))) for _ in range(150)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = packing.best_two_fit(docs, vocabularies.path("word_bpe_49k.json"), capacity=256).collect()
    by: dict = {}
    for v in rows:
        by.setdefault(v["sequence_id"], []).append((v["offset"], v["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    whole: dict = {}
    for v in sorted(rows, key=lambda v: (v["doc_id"], v["piece"])):
        assert v["start"] == whole.get(v["doc_id"], 0) == v["piece"] * 256
        whole[v["doc_id"]] = v["start"] + v["length"]
    assert whole.keys() == set(range(len(texts)))


def test_other_tokenizers_are_packed_by_the_library(spark):
    path = vocabularies.path("byte_bpe_50k.json")
    assert packing.splits_at_words(vocabularies.path("word_bpe_49k.json")) and not packing.splits_at_words(path)
    texts = ["It's  Mixed Case\n", "日本 é"]
    from millrace.llm.bytebpe import json_tokenizer

    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, ids=True).collect()
    assert {v["doc_id"]: v["ids"][:-1] for v in rows} == {k: json_tokenizer(path).encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_a_null_id_is_not_an_empty_one(spark):
    df = spark.createDataFrame([("", 0, "user", "a"), (None, 0, "user", "b"), ("=", 0, "user", "c"), (None, 1, "assistant", "d")], "conv_id string, turn int, role string, text string")
    assert {v["conv_id"]: v["n_turns"] for v in replytree.format_turns(df).collect()} == {"": 1, None: 2, "=": 1}


def test_messages_with_nulls_and_cycles(spark):
    rows = [("t", 1, None, None, None, None), ("t", 2, 1, "assistant", "x", None), ("t", None, 1, "user", "y", 1.0), (None, 1, None, "user", "z", 1.0), ("c", 1, 2, "user", "p", 0.0), ("c", 2, 1, "user", "q", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double")
    found = replytree.conversations_of(df).collect()
    assert [(v["tree"], v["n_turns"]) for v in found] == [("t", 2)]
    assert replytree.read_back(found[0]["formatted"]) == [("", ""), ("assistant", "x")]
    assert replytree.conversations_of(df.limit(0)).count() == 0


def test_shown_text_of_formulas_objects_and_drawings():
    source = "<article><p>area <math><mi>x</mi><annotation>\\x</annotation></math> is <svg><title>icon</title><text x=1>wide <tspan>5</tspan></text></svg>, <object data=a>not shown, but told</object> <canvas>a chart</canvas> end<noscript>script off</noscript></p><xmp><b>as & is</b></xmp><p>Last one here.</p></article>"
    assert " ".join(dom.Page(source).run_text) == "area x is wide 5 , not shown, but told a chart end <b>as & is</b> Last one here."
    whole = maintext.main_texts([f"<html><body><nav><a href=1>Home</a></nav>{source}</body></html>"], maintext.trees())
    assert whole == ["area x is wide 5 , not shown, but told a chart end <b>as & is</b> Last one here."]


def test_trees_predict_by_their_thresholds():
    r = np.random.default_rng(36)
    x = r.normal(size=(400, 4))
    model = boost.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=5, depth=3)
    for row in x[:20]:
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - 7]
        assert total == pytest.approx(model.odds(row[None])[0])
