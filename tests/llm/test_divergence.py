"""Divergence of sources against summing over all terms, and on odd inputs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import divergence


def plain(rows, least, top=50):
    counts, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        within[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in within[lang].items() if n >= least]
        share = {}
        every = Counter()
        for g in groups:
            if g[0] == lang:
                every.update({t: counts[g][t] for t in kept})
        for name, c in [(s, counts[lang, s]) for x, s in groups if x == lang] + [(None, every)]:
            total = sum(c[t] for t in kept)
            share[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for _, s in (g for g in groups if g[0] == lang):
            away = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for x, o in groups if x == lang and o != s]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(away), 1)}
            more = [(share[None][t] - share[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(more)[:top], 1)}
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé日Z" for b in ["", "x", "yy", "ñ"]]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0", "s0", "s1", "é", None, "s3"])
        share = [1 / (1 + (k * (3 if source == "s1" else 5)) % 17) for k in range(len(words))]
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(words, share, k=rng.randint(0, 30))) + rng.choice(["", "1A-b", "."])))
    return rows


@pytest.mark.parametrize("seed,least", [(1, 30), (2, 5), (3, 1)])
def test_equals_sum_over_terms(spark, seed, least):
    rows = [*made(seed), ("fr", "s0", None), ("fr", "s9", ""), ("it", None, "uno due"), *made(seed)[:3]]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    found = divergence.divergence(docs, least, 6).collect()
    assert {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found} == plain(rows, least, 6)
    assert len(found) == len(set(found))


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert divergence.divergence(none).count() == 0
    rows = [(None, None, "a b"), (None, None, None), ("", "x", "c")]
    found = divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    # nothing is kept, so the two groups of the empty language are at distance 0
    assert sorted(tuple(r) for r in found) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 5)
    data = "ab éé ccccccccccccc d".encode()
    assert b"".join(divergence.slices(data)) == data
    assert [t for part in divergence.slices(data) for t in divergence.TERM.findall(part)] == [b"ab", "éé".encode(), b"ccccccccccccc", b"d"]


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.lit(10**15).alias("n"), F.lit(3 * 10**15 + 1).alias("total"), F.lit(7).alias("terms"))
    assert df.select(divergence.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 1 + 35)
