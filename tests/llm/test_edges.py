"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import public_tokenizers as vocabularies

from millrace.llm import bytebpe, jaccard, langid, maintext, packing, quality, rabitq, replytree, vptree

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_tokens bigint, node bigint, component bigint, length bigint, piece int, p string"
LONG = "very long words " * 40_000


def rows(*pairs):
    return [(i, t, "en", "s", 0, 0.5, 1, 2, 3, 4, 5, "x") for i, t in pairs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows((1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (8, LONG), (9, "日本語 \U0001f600 é é <|endoftext|> \x1c \x85"), (10, "... 123 !!!")), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def same_rows(df, docs):
    assert df.count() == docs.count()
    return {r["doc_id"]: r for r in df.collect()}


def test_byte_bpe(docs, nothing):
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    found = same_rows(bytebpe.encode_decode(docs, path, vocabularies.PATTERN), docs)
    assert found[1]["n_tokens"] == found[2]["n_tokens"] == 0
    assert found[1]["ids_sha256"] == found[2]["decoded_sha256"]
    assert bytebpe.encode_decode(nothing, path, vocabularies.PATTERN).count() == 0


def test_token_counts(docs, nothing):
    path = vocabularies.path("byte_bpe_50k.json")
    found = same_rows(bytebpe.count_tokens(docs, path), docs)
    tok = bytebpe.json_tokenizer(path)
    for r in docs.collect():
        if r["doc_id"] is not None:
            assert found[r["doc_id"]]["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False))
            assert found[r["doc_id"]]["n_bytes"] == len((r["text"] or "").encode())
    assert found[8]["over_limit"] and not found[4]["over_limit"]
    assert bytebpe.count_tokens(nothing, path).count() == 0


def test_token_counts_of_a_piece_model(docs):
    path = vocabularies.path("piece_bpe_32k.model")
    found = same_rows(bytebpe.count_tokens(docs, path), docs)
    assert found[9]["n_tokens"] == len(bytebpe.piece_model(path).encode(docs.filter("doc_id = 9").first()["text"]))


def test_language(docs, nothing):
    found = same_rows(langid.identify(docs), docs)
    assert {found[k]["lang_pred"] for k in (1, 2, 3, 10)} == {"und"} and found[1]["score"] == 0
    assert found[8]["lang_pred"] in ("en", "und")
    assert langid.identify(nothing).count() == 0
    assert set(langid.kept(docs).columns) == set(docs.columns)


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 1), (8, 1), (5, 0), (5, 1), (None, 1)], "doc_id bigint, quality int")
    found = same_rows(quality.classify(docs, labels), docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0
    assert quality.kept(docs, labels).columns == docs.columns


def test_jaccard(docs, nothing):
    df = jaccard.near_duplicates(docs)
    found = same_rows(df, docs)
    assert [found[k]["component_id"] for k in (1, 2, 3, 4, 5, None)] == [1, 2, 3, 4, 4, 4]
    assert [found[k]["n_shingles"] for k in (1, 2, 3, 4, 10)] == [0, 0, 0, 2, 1]
    assert jaccard.near_duplicates(nothing).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 8, 9, 10]


def test_packing(docs, nothing):
    path = vocabularies.path("word_bpe_49k.json")
    packed = packing.best_two_fit(docs, path)
    whole = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in whole) <= 2048
    assert packed.filter("doc_id = 1").first()["length"] == 1
    assert packed.filter("doc_id = 5").count() == 2
    tok = bytebpe.json_tokenizer(path)
    for i in (8, 9):
        text = docs.filter(f"doc_id = {i}").first()["text"]
        assert packed.filter(f"doc_id = {i}").agg({"length": "sum"}).first()[0] == len(tok.encode(text, add_special_tokens=False)) + 1
    assert packing.best_two_fit(nothing, path).count() == 0


BAD = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None]]


@pytest.fixture(scope="module")
def vectors(spark):
    good = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in good + [(100 + k, v) for k, v in enumerate(BAD)]], "vec_id bigint, embedding array<float>, label string, node int")


def test_nearest(vectors):
    found = vptree.nearest(vectors, vectors, k=2).collect()
    by = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in found}}
    assert by == {1: [3, 2], 2: [1, 3], 3: [1, 2], 4: [3, 1]}
    assert vptree.nearest(vectors.limit(0), vectors).count() == 0 == vptree.nearest(vectors, vectors.limit(0)).count()


def test_embedding_duplicates(vectors):
    df = rabitq.near_duplicates(vectors)
    assert df.count() == vectors.count()
    found = {r["vec_id"]: r for r in df.collect()}
    assert [found[k]["n_links"] for k in (1, 2, 3, 4, 5)] == [2, 2, 2, 0, 0]
    assert [found[k]["component_id"] for k in (1, 2, 3, 4, 5, 100)] == [1, 1, 1, 4, 5, 100]
    assert found[100]["kept"] and not found[2]["kept"]
    assert rabitq.near_duplicates(vectors.limit(0)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a </s> \\b \\"), (2, None, "bot]x", "[ROLE a] t [/ROLE]"), (2, 0, "system", "<<SYS>>"), (3, 0, "user", "u"), (3, 0, "user", "u"), (None, 0, "assistant", " x "), (4, 0, None, LONG)]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, node int, tree string")
    found = {r["conv_id"]: r for r in replytree.format_turns(df).collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 2, 2: 2, 3: 2, None: 1, 4: 1}
    assert found[1]["loss_chars"] == len("a </s> \\b \\") and found[None]["loss_chars"] == 3
    assert replytree.format_turns(df.limit(0)).count() == 0


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p>", "x"), (3, None, "<p>", "x"), (4, "u", "<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>" + "word and &amp; word. " * 20_000 + "</article>", "x"), (5, "u", "<" * 3000 + '<a title="' * 300, "x")], "page_id bigint, url string, html string, text string")
    found = maintext.extract(pages)
    assert found.count() == 6
    by = {r["page_id"]: r for r in found.collect()}
    assert by[1]["text"] == by[2]["text"] == by[3]["text"] == "" and by[1]["n_chars"] == 0
    assert by[4]["text"].startswith("T word and & word.") and by[4]["n_chars"] == len(by[4]["text"])
    assert maintext.extract(pages.limit(0)).count() == 0


def test_ids_with_several_vectors(spark):
    """An id stands for one vector, whatever the order of rows, and all its rows have that vector's result."""
    from millrace.llm import rabitq, vptree

    one, other, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, one), (2, one), (3, other), (4, other), (7, one), (7, other), (9, far), (9, far)]
    results = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        results.append(sorted(map(tuple, rabitq.near_duplicates(df).collect())))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    found = {r[0]: r[1:] for r in results[0]}
    with_one = found[7][1] == 1  # component of the vector that counts
    assert found[7] == ((2, 1, False) if with_one else (2, 3, False))
    assert found[1] == found[2][:1] + (1, True) and found[1][0] == (2 if with_one else 1) and found[3][0] == (1 if with_one else 2)
    assert found[9] == (0, 9, True)
    near = vptree.nearest(df, df.filter("vec_id in (1, 7)")).collect()
    assert all(len({r["vec_id"] for r in near if r["query_id"] == q}) == len([r for r in near if r["query_id"] == q]) == 5 for q in (1, 7))


def test_squares_that_over_and_underflow(spark):
    from millrace.llm import rabitq

    rows = [(1, [1e200, 1e200]), (2, [3.0, 3.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (5, [1e300, 1e-300])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}
