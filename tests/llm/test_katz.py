"""The backoff model against a plain one, as a distribution, and on odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import katz

BEGIN, END = "<begin>", "<end>"


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split() + [END]


def plain(texts, order):
    """Counts, discounts and a function log10 P of a text, with dictionaries and recursion."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        seq = [BEGIN, *words_of(t)]
        for i in range(1, len(seq)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[k][tuple(seq[i - k + 1 : i + 1])] += 1
    rules = []
    for k in range(1, order + 1):
        n = Counter(grams[k].values())
        rules.append(katz.good_turing(sum(grams[k].values()), (len(grams[k]), *[n[r] for r in range(1, katz.DISCOUNTED + 2)])))
    after = [None, None] + [{} for _ in range(order)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            after[k].setdefault(g[:-1], []).append((g[-1], c))

    def kept(rule, c):
        return c - 0.5 if not rule.keeps else c * (rule.keeps[c - 1] if c <= len(rule.keeps) else 1)

    def p(w, history):
        if not history:
            total = sum(grams[1].values())
            if not total:
                return 1.0
            if c := grams[1][(w,)]:
                return kept(rules[0], c) / total
            return 1 - sum(kept(rules[0], c) for c in grams[1].values()) / total
        found = after[len(history) + 1].get(history)
        if not found:
            return p(w, history[1:])
        rule, total = rules[len(history)], sum(c for _, c in found)
        left = total - sum(kept(rule, c) for _, c in found)
        if left < 1e-9:
            left, total = 1.0, total + 1
        c = dict(found).get(w)
        return kept(rule, c) / total if c else left / total / (1 - sum(p(x, history[1:]) for x, _ in found)) * p(w, history[1:])

    def score(t):
        seq = [BEGIN, *words_of(t)]
        return sum(math.log10(p(seq[i], tuple(seq[max(0, i - order + 1) : i]))) for i in range(1, len(seq)))

    return grams, p, score


def made_texts(n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "a'b"]
    share = 1 / np.arange(1, len(words) + 1)
    out = [" ".join(rng.choice(words, rng.integers(0, 40), p=share / share.sum())) for _ in range(n)]
    return [*out, None, "", " \t\n", out[0], out[0], "W1 W2\x0bW3"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_model(spark, order):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, chunk int")
    rows = {r["doc_id"]: r for r in katz.scored(docs, order).collect()}
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    train = [t for i, t in enumerate(texts) if i not in held]
    grams, _, score = plain(train, order)
    total, kinds = sum(grams[1].values()), len(grams[1])
    assert held and len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = words_of(t)
        n = [grams[1][(x,)] for x in w]
        assert rows[i]["held_out"] == (i in held)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(w), sum(x > 0 for x in n), total)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((x + 0.5) / (total + 0.5 * (kinds + 1))) for x in n), abs=1e-9)
        assert rows[i]["score"] == pytest.approx(score(t), abs=1e-9)


def test_adds_up_to_one():
    texts = made_texts(120, 5)
    grams, p, _ = plain(texts, 3)
    every = [g[0] for g in grams[1]] + ["unknown"]
    for history in [(), (BEGIN,), (b"w0",), (b"w1", b"w0"), (b"w39",), (BEGIN, b"w2"), (b"never",)]:
        assert sum(p(w, history) for w in every) == pytest.approx(1, abs=1e-9)


def test_texts_over_several_chunks_and_frequent_histories(spark, monkeypatch):
    """Chunks, slices and partitions as small as they get change nothing."""
    texts = made_texts(30, 8) + [" ".join(["a b c d"] * 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: r for r in katz.scored(docs, 3).collect()}
    monkeypatch.setattr(katz, "CHUNK", 50)
    monkeypatch.setattr(katz, "SLICE", 40)
    monkeypatch.setattr(katz, "HOT", 3)
    chunks = katz.chunked(docs, 3, F.lit(True), F.lit(False), "doc_id", "text").collect()
    assert len(chunks) > 10
    # tasks read the constants of their own process: run the chunks' code here, partition by partition
    answers = {}
    for level, buckets in ((1, 5), (2, 7), (3, 3)):
        asked = {}
        for c in chunks:
            state = walked(c, answers, level)
            for b, blob in state.ask_words(5) if level == 1 else state.ask(buckets):
                asked.setdefault(b, []).append((c["chunk"], blob))
        import pyarrow as pa

        found, counts = {}, np.zeros(katz.DISCOUNTED + 3, int)
        for b, rows in asked.items():
            t = pa.table({"chunk": [x for x, _ in rows], "bucket": [b] * len(rows), "blob": [x for _, x in rows]})
            merge = katz.word_table(1, 5, pa.int64()) if level == 1 else katz.gram_table(level, buckets, pa.int64(), level < 3)
            for r in merge(t).to_pylist():
                if r["chunk"] >= 0:
                    found.setdefault(r["chunk"], {})[b] = r["blob"]
                elif r["chunk"] == katz.COUNTS:
                    counts += r["counts"]
        answers[level] = (buckets, katz.good_turing(int(counts[0]), tuple(map(int, counts[1:]))), found)
    grams, _, score = plain(texts, 3)
    got = Counter()
    for c in chunks:
        key, _, _, _, _, s = walked(c, answers, 4).scores(answers[1][1])
        for d, x in zip(c["ids"], s, strict=True):
            got[d] += x
    assert len(want) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(score(t), abs=1e-8)


def walked(c, answers, level):
    state = katz.Chunk(c["blob"])
    for k in range(1, level):
        buckets, discounts, found = answers[k]
        if k == 1:
            state.answer_words(found.get(c["chunk"], {}), buckets, discounts)
        else:
            state.answer(found.get(c["chunk"], {}), buckets, discounts, k < 3)
    return state


def test_model_scores_other_documents(spark):
    texts = made_texts(50, 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, own = katz.model_and_scores(docs, F.lit(True), F.lit(False), 2)
    _, again = katz.model_and_scores(docs.filter("doc_id % 2 = 0").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), None, F.lit(False), 2, model)
    want = {f"d{r['doc_id']}": r["score"] for r in own.collect()}
    got = again.collect()
    assert len(got) == (len(texts) + 1) // 2
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
    model.delete()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.scored(empty).count() == 0
    # nothing is learned from a null id, so all is unknown
    rows = katz.scored(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["held_out"]) for r in rows) == [(1, 0, 0, 0.0, 0.0, False), (3, 0, 0, 0.0, 0.0, False)]


def test_discounts():
    good = katz.good_turing(1000, (500, 300, 100, 45, 25, 16, 11))
    assert len(good.keeps) == 5 and all(0 < a < b < 1 for a, b in zip(good.keeps, good.keeps[1:], strict=False))
    # what is taken is what n-grams seen once have
    assert float(good.taken(good.having)) == pytest.approx(300)
    assert katz.good_turing(10, (3, 0, 1, 1, 0, 0, 0)).keeps == ()
    assert katz.good_turing(10, (3, 0, 1, 1, 0, 0, 0))(np.array([0, 1, 4])).tolist() == [0, 0.5, 3.5]


def test_packed():
    a, b = np.array([5, 2**63, 0], np.uint64), np.array([0.5, -1.0])
    x, y, z = katz.unpack(katz.pack(a, b, np.zeros(0)))
    assert x.tolist() == a.tolist() and y.view(np.float64).tolist() == [0.5, -1.0] and len(z) == 0
