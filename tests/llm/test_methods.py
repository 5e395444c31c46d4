"""The methods against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest

import public_tokenizers as vocabularies

from millrace.llm import boost, bytebpe, dom, jaccard, langid, mainsample, maintext, packing, quality, rabitq, replytree, shingles, vptree
from millrace.llm.components import components

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def made_texts(seed, n, words=60):
    """Texts of which many are copies with edits, and all share a passage now and then."""
    r = random.Random(seed)
    base = [" ".join(r.choices("abcdefghij", k=r.randint(1, 3)) and ["".join(r.choices("abcdefghij", k=3)) for _ in range(r.randint(1, words))]) for _ in range(n // 3)]
    passage = " ".join("common" + str(k) for k in range(12))
    out = []
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = "".join(r.choices("klmnop", k=4))
        out.append(" ".join(w) + (" " + passage if r.random() < 0.3 else ""))
    return out


def reach(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            lo = min(label[a], label[b])
            if label[a] != lo or label[b] != lo:
                label[a] = label[b] = lo
                changed = True
    return label


@pytest.mark.parametrize("seed, family", [(1, 24), (2, 1)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, seed, family):
    monkeypatch.setattr(jaccard, "FAMILY", family)
    texts = made_texts(seed, 150)
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    label = reach(len(texts), pairs)
    assert found == {i: (len(sets[i]), label[i]) for i in range(len(texts))}


@pytest.mark.parametrize("hot", [1, 30])
def test_frequent_shingles_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "FAMILY", 3)
    texts = made_texts(41, 150)
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    label = reach(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_one_prefix_of_many_sets_that_do_not_link(spark):
    """The rare shingles at the beginning are the same in all; what follows is one of few, each frequent."""
    r = random.Random(42)
    head = " ".join(f"head{k}" for k in range(12))
    blocks = [" ".join(f"b{k}x{j}" for j in range(6)) for k in range(30)]
    texts = [head + " " + " ".join(r.sample(blocks, 5)) for _ in range(3000)]
    texts += [" ".join(r.sample(blocks, 5)) for _ in range(3000)]  # so that the blocks are more frequent than the head
    texts += [texts[0] + " more", texts[0].replace("head0", "head")]
    sets = [frozenset(shingles.shingles(t).tolist()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {v["doc_id"]: v["component_id"] for v in jaccard.near_duplicates(docs).collect()}
    by: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    common: dict = {}
    for ks in by.values():
        for a, b in itertools.combinations(ks, 2):
            common[a, b] = common.get((a, b), 0) + 1
    label = reach(len(texts), [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)])
    assert found == dict(enumerate(label))


def test_shingles_are_of_lower_cased_ascii_words():
    assert len(shingles.shingles("A b\tC\x0bd e")) == 1
    assert (shingles.shingles("A b c d e") == shingles.shingles("a B  c\nd e")).all()
    assert len(shingles.shingles("Ä b c d e f")) == 2 and (shingles.shingles("Ä") != shingles.shingles("ä")).all()
    assert (shingles.shingles("a b") != shingles.shingles("a b a b a")[:1]).all()


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)] + [(k + 1, k) for k in range(400, 410)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 203)} | {k: 400 for k in range(400, 411)}


def test_safe_pieces_encode_as_the_whole():
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    r = random.Random(3)
    text = "".join(r.choice(["ab", " ", "  ", "\n", "'s", "12", "!?", "é", "日", "\U0001f600", "　", "\x1c", "\x85"]) for _ in range(4000))
    whole = bytebpe.rank_encoder(path, pattern).encode_ordinary(text)
    for size in (1, 7, 100, 3999):
        pieces = list(bytebpe.safe_pieces(text, size))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in bytebpe.rank_encoder(path, pattern).encode_ordinary(p)] == whole
    assert bytebpe.decode_bytes(whole, path, pattern) == text.encode()
    assert bytebpe.decode_bytes(whole[:-1], path, pattern) == text.encode()[: len(bytebpe.decode_bytes(whole[:-1], path, pattern))]


WHITE = [" ", "\n", "\t", " \n", "\t  \r\n", "\u3000 "]


@pytest.mark.parametrize("white", WHITE)
def test_runs_of_white_space_encode_as_the_whole(white):
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    whole = bytebpe.rank_encoder(path, pattern).encode_ordinary
    run = white * 40
    for text in (run, "ab" + run, run + "cd", "a b" + run + "c d" + run + "!", run + "'s" + run + " x" + run, "a" + run + "é" + run + "\n1"):
        got = list(bytebpe.parts(text, size=20, run=30))
        assert "".join(p for p, _ in got) == text and any(single for _, single in got)
        enc = bytebpe.rank_encoder(path, pattern)
        assert [i for p, single in got for i in (enc._encode_single_piece(p) if single else enc.encode_ordinary(p))] == whole(text)


@pytest.mark.parametrize("white", WHITE)
def test_millions_of_white_space_encode_and_decode(white):
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    text = "begin" + white * (3_000_000 // len(white)) + "middle" + white * (2_000_000 // len(white))
    assert bytebpe.decode_bytes(bytebpe.encode(text, path, pattern), path, pattern) == text.encode()


def test_digests_of_encoded_documents(spark):
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    texts = [None, "", "a  b\n\n<|endoftext|> é日\U0001f600", "x" + " " * 150_000 + "y" * 10, *made_texts(14, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.encode_decode(docs, path, pattern).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [bytebpe.rank_encoder(path, pattern).encode_ordinary(t or "") for t in texts]
    assert found == {k: (len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for k, (x, t) in enumerate(zip(ids, texts, strict=True))}


def test_token_columns_round_trip(spark):
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id bigint, text string")
    back = bytebpe.with_text(bytebpe.with_ids(docs, path, pattern), path, pattern).collect()
    assert [bytes(r["decoded"]).decode() for r in sorted(back, key=lambda r: r["doc_id"])] == ["héllo wörld", ""]


def test_word_encoder_equals_the_library():
    path = vocabularies.path("word_bpe_49k.json")
    enc, tok, r = packing.WordEncoder(path, entries=50), bytebpe.json_tokenizer(path), random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["Ab", "İ", " ", "\x1c", "'LL", "12", "!?", "é", "é", "日", "Ⱥ", "<|endoftext|>", "\xa0", "\x00", "ßẞ"]) for _ in range(30))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("tokens, slice_, buckets", [(1 << 19, 1 << 15, 256), (60, 2, 5), (1, 1, 1)])
def test_token_counts_equal_the_library(spark, monkeypatch, tokens, slice_, buckets):
    path, r = vocabularies.path("byte_bpe_50k.json"), random.Random(5)
    monkeypatch.setattr(bytebpe, "SLICE", slice_)
    monkeypatch.setattr(bytebpe, "BUCKETS", buckets)
    monkeypatch.setattr(bytebpe.chunks, "__defaults__", (tokens,))
    tok = bytebpe.json_tokenizer(path)
    texts = [None, "", " " * 200_000, *["".join(r.choice(["Ab", " ", "  ", "\n", "'ll", "12", "!?", "é", "日", "<|endoftext|>", "\xa0", "\x1c", "\xbd", "_"]) for _ in range(30)) for _ in range(60)]]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    found = sorted((v["doc_id"], v["n_bytes"], v["n_tokens"], v["over_limit"]) for v in bytebpe.count_tokens(docs, path, limit=25).collect())
    n = [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]
    assert found == sorted((k // 2, len((t or "").encode()), n[k], n[k] > 25) for k, t in enumerate(texts))


def test_only_byte_level_tokenizers_are_counted_by_pretoken(tmp_path):
    import json

    path = vocabularies.path("byte_bpe_50k.json")
    assert bytebpe.splits_at_bytes(path) and not bytebpe.splits_at_bytes(vocabularies.path("word_bpe_49k.json"))
    told = json.load(open(path, encoding="utf-8"))
    for k, change in enumerate(({"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}, {"normalizer": {"type": "NFC"}})):
        (tmp_path / f"{k}.json").write_text(json.dumps(told | change))
        assert not bytebpe.splits_at_bytes(str(tmp_path / f"{k}.json"))


def test_plan_fills_bins():
    r = random.Random(6)
    for cap, n in ((10, 40), (2048, 3000)):
        counts: dict[int, int] = {}
        for _ in range(n):
            k = min(cap, int(r.expovariate(4 / cap)) + 1)
            counts[k] = counts.get(k, 0) + 1
        bins, left = packing.plan(counts, cap), dict(counts)
        for lengths, times in bins:
            assert sum(lengths) <= cap and times > 0
            for k in lengths:
                left[k] -= times
        assert not any(left.values())
        assert sum(t for _, t in bins) <= -(-sum(k * c for k, c in counts.items()) // cap) + 1


def test_two_replace_the_smallest():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]


def test_vantage_tree():
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 16)) * 6
    x = centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16))
    x[5] = x[6] = x[7]
    ids = r.permutation(3000)
    tree, own = vptree.Tree(x, ids), np.arange(100)
    q = x[np.argsort(ids)[:100]]
    d, who = tree.search(q, own, 10)
    exact = tree.computed
    for k in range(100):
        every = vptree.distances(q[k][None], x)[0]
        every[ids == own[k]] = np.inf
        assert who[k].tolist() == ids[np.lexsort((ids, every))[:10]].tolist()
    tree.computed = 0
    loose = tree.search(q, own, 10, factor=0.5)[1]
    assert tree.computed < exact < 100 * 3000
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(loose, who, strict=True)]) >= 0.9


@pytest.mark.parametrize("shard, factor", [(65536, 1.0), (60, 1.0), (60, 0.6)])
def test_nearest_equals_all_distances(spark, monkeypatch, shard, factor):
    r = np.random.default_rng(21)
    monkeypatch.setattr(vptree, "LEAF", 8)
    centres = r.normal(size=(12, 6)) * 4
    x = (centres[r.integers(0, 12, 900)] + r.normal(size=(900, 6))).round(1)  # with ties
    x[300:600] = x[300]  # a third is one vector, and its pivot's shard is cut
    ids = (np.arange(900) - 450) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += rows[:40] + [(-1, [1.0, 2.0]), (-1, [1.0, 2.0]), (-2, [1.0, 2.5])]  # repeated rows, and another length
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    asked = df.filter("vec_id % 5 = 0 or vec_id in (-1, -2)")
    found: dict = {}
    for v in vptree.nearest(df, asked, 10, factor, shard).orderBy("query_id", "rank").collect():
        assert v["rank"] == len(found.setdefault(v["query_id"], [])) + 1
        found[v["query_id"]].append((v["vec_id"], v["score"]))
    x = x.astype(np.float32).astype(float)
    want = {-1: [(-2, 0.5)], -2: [(-1, 0.5)]}
    for q in range(900):
        if ids[q] % 5 == 0:
            d = vptree.distances(x[q][None], x)[0]
            d[q] = np.inf
            want[int(ids[q])] = [(int(ids[k]), float(d[k])) for k in np.lexsort((ids, d))[:10]]
    assert found.keys() == want.keys()
    if factor == 1:
        assert found == want
    else:
        assert np.mean([len({v for v, _ in found[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()]) >= 0.9


def test_pivots_pass_over_only_what_cannot_be_nearer():
    pivots = vptree.Pivots({2: np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 100.0]])})
    pivots.radius, pivots.shards = {(2, 0): 1.0, (2, 1): 2.0, (2, 2): 1.0}, {(2, 0): 2, (2, 1): 1, (2, 2): 1}
    q = np.array([[0.5, 0.0]])
    assert pivots.routes(q, np.array([1.0]), 1.0) == [[0, 0, 0, 1]]
    assert pivots.routes(q, np.array([7.5]), 1.0) == [[0, 0, 0, 1, 1, 0]]
    assert pivots.routes(q, np.array([np.inf]), 1.0) == [[0, 0, 0, 1, 1, 0, 2, 0]]
    assert pivots.routes(np.zeros((1, 3)), np.array([1.0]), 1.0) == [[]]


def near_vectors(seed, n, d):
    """Random vectors, of which a third are near others by all degrees."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[n // 3 : n // 3 * 2] = x[: n // 3] + r.normal(size=(n // 3, d)) * r.uniform(0.05, 0.6, (n // 3, 1))
    return x


def cosines(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ unit.T


@pytest.mark.parametrize("d", [64, 33])
def test_estimates_are_unbiased_and_doubt_covers_links(d):
    x = near_vectors(8, 1500, d)
    truth = cosines(x)
    codes = rabitq.Codes.of(x / np.linalg.norm(x, axis=1, keepdims=True))
    error = np.concatenate([codes.estimates(codes, slice(s, s + 500)) for s in (0, 500, 1000)]) - truth
    away = truth < 0.5
    assert abs(error[away].mean()) < 0.003 and 0.05 < error[away].std() < 0.2
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(truth >= 0.95, 1)), strict=True)}
    got = [(i, j) for p, q in rabitq.doubtful(codes, codes, 0.95, True) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    assert want and want <= set(got) and len(got) == len(set(got)) < 0.02 * 1500 * 1500


@pytest.mark.parametrize("d, cells", [(64, 16), (64, 400), (64, 4096), (8, 64), (2, 16)])
def test_linked_vectors_share_a_cell(d, cells):
    r = np.random.default_rng(9)
    x, w = r.normal(size=(2, 20_000, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w -= (w * x).sum(1, keepdims=True) * x
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * w  # the farthest that vectors with a link are apart
    a, b = (rabitq.cells_of(v, cells, 0.95) for v in (x, y))
    assert sum(not set(p.tolist()) & set(q.tolist()) for p, q in zip(a, b, strict=True)) <= 1
    if d == 64:
        assert np.mean([len(p) for p in a]) < cells**0.5


@pytest.mark.parametrize("block, cell", [(4096, 128), (40, 30), (7, 5)])
def test_embedding_links_equal_all_pairs(spark, block, cell):
    r = np.random.default_rng(12)
    x = near_vectors(13, 600, 32)
    x[400:560] = x[400] + r.normal(size=(160, 32)) * 0.15  # a family that fills cells
    x[560:600] = x[400]  # and copies
    ids = r.permutation(600) - 300  # negative ids, too
    links = cosines(x.astype(np.float32).astype(float)) >= 0.95
    np.fill_diagonal(links, False)
    label = reach(600, list(zip(*np.nonzero(links), strict=True)))
    groups = {c: min(int(ids[k]) for k in range(600) if label[k] == c) for c in set(label)}
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>").repartition(5)
    found = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in rabitq.near_duplicates(df, block=block, cell=cell).collect()}
    assert found == {int(ids[k]): (int(links[k].sum()), groups[label[k]]) for k in range(600)}


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(9)
    x = r.normal(size=(2000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boost.fit(x[:1000], y[:1000], trees=40)
    assert ((model.odds(x[1000:]) > 0) == y[1000:]).mean() > 0.93


def test_decoding_keeps_nothing_inside_what_is_dropped():
    page = dom.Page("<div><p>a</p><nav><p>b</p></nav></div><p>c</p>")
    keep = page.decode(np.array([0.0, 1.0, 2.0, -5.0, 3.0, -1.0]))
    assert keep.tolist() == [True, True, True, False, False, False] and page.text(keep) == "a"
    assert page.decode(np.array([0.0, -1.0, 2.0, -5.0, 3.0, 1.0])).tolist() == [True, True, True, False, False, True]


def test_main_text_of_unseen_layouts():
    model, maker, same = maintext.trees(), mainsample.Maker(4321), 0
    for _ in range(120):
        source = maker.page()
        main = " ".join(t.replace(mainsample.MARK, "") for t in dom.Page(source).run_text if mainsample.MARK in t)
        same += maintext.main_texts([source.replace(mainsample.MARK, "")], model) == [main]
    assert same >= 108


def test_page_parts_are_left_out():
    page = "<html><head><title>x</title></head><body><header><p>Site</p></header><nav><ul><li><a href=1>Home</a></li></ul></nav><div class=cookie-notice><p>We use cookies.</p></div><article><h1>Big news</h1><p>First &lt;b&gt; para\n graph, with <b>bold</b>ness.</p><div class='ad'>Buy now.</div><p>Second one.</p></article><section id=comments><h2>Comments</h2><div class=comment><p>I liked this very much, thank you.</p></div></section><aside class=sidebar><p>Related things to read.</p></aside><form><p>Subscribe</p></form><footer><p>Imprint</p></footer></body></html>"
    assert maintext.main_texts([page], maintext.trees()) == ["Big news First <b> para graph, with boldness. Second one."]


@tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98


def test_unbiased_risk_finds_the_prior_and_the_classes():
    r = np.random.default_rng(10)
    good, bad = (lambda n: r.normal(1.5, 1, (n, 4))), (lambda n: r.normal(-1.5, 1, (n, 4)))
    positive, unlabelled = good(2000), np.concatenate([good(1400), bad(600)])
    prior = quality.class_prior(positive, unlabelled)
    assert abs(prior - 0.7) < 0.08
    net = quality.fit(positive, unlabelled, prior)
    assert (net.score(good(1000)) > 0.5).mean() > 0.95 and (net.score(bad(1000)) < 0.5).mean() > 0.9


@tables
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_branches_are_ranked_and_formatted(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 2.0), ("t", 3, 1, "assistant", "bad", -1.0), ("t", 4, 2, "user", "more", 0.0), ("t", 5, 4, "assistant", "end", 1.0), ("u", 1, 9, "user", "alone", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double")
    found = {(r["tree"], r["branch"]): r for r in replytree.conversations_of(messages).collect()}
    assert replytree.read_back(found["t", 1]["formatted"]) == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")]
    assert replytree.read_back(found["t", 2]["formatted"]) == [("user", "q"), ("assistant", "bad")]
    assert found["u", 1]["n_turns"] == 1 and len(found) == 3
    assert replytree.conversations_of(messages, branches=1).count() == 2
    text = found["t", 1]["formatted"]
    assert "".join(text[s["begin"] : s["end"]] for s in found["t", 1]["loss"]) == "goodend"


def test_escapes_are_reversible():
    r = random.Random(11)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]", "\\", "l", "b", "e", "]", "<", "[", " ", "\n", "x"]
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "system", "tool", "a]b"]), "".join(r.choices(bits, k=r.randint(0, 12)))) for _ in range(3)]
        text, spans = replytree.formatted(turns)
        assert replytree.read_back(text) == turns
        assert [replytree.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]
        assert not replytree.CONTROL.search(replytree.escape(turns[0][1]))


@tables
def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "jaccard_join", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "jaccard_join":
            keys = sorted(before)
            sets = [set(shingles.shingles(before[k]).tolist()) for k in keys]
            pairs = [(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
            assert set(texts) == {keys[k] for k in set(reach(len(keys), pairs))}
    packed = corpus_pipeline.run(spark, DATA).collect()
    tok = bytebpe.json_tokenizer(vocabularies.path("word_bpe_49k.json"))
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == {(k, s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes())) for k, x in ids.items() for s in range(0, len(x), 2048)}


def test_language_counts_in_slices():
    """A long text is cut only where no n-gram goes on and no letter is lower-cased in another way."""
    import random

    from millrace.llm import langid

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab Éß日'ΣσİI_9\n.-,") for _ in range(rng.randint(0, 200)))
        whole, cut = langid.counted(langid.grams(text)), langid.counts_of(text, rng.choice([1, 3, 10]))
        assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()
