"""The pipeline and its stages on nulls, empty and repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline

WORDS = "the quick brown fox jumps over the lazy dog and runs far away from home".split()
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, _lang string, _quality double, score double, component bigint, node bigint, sig string, id bigint"


def rows():
    good = [(k, " ".join(WORDS[(k * 7 + j * (k % 5 + 1)) % len(WORDS)] + ("s" if (k + j) % 3 else "") for j in range(40 + k)) + ".", "en") for k in range(40)]
    bad = [(100 + k, "!!! $$ 99 " * (20 + k), "en") for k in range(10)]
    odd = [(200, None, "en"), (201, "", None), (202, " \n\t ", "en"), (None, "a text without an id that says little", "en"), (203, "x" * 50_000, "en"), (204, "日本語 の 文", None), (0, good[0][1], "en"), (205, good[3][1], "en"), (206, good[3][1], None)]
    return [(i, t, lang, "s", 1, "a", 0.1, 0.2, 3, 4, "b", 5) for i, t, lang in good + bad + odd]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), NAMES).repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(k, 1, 0) for k in range(30)] + [(100 + k, 0, 0) for k in range(10)] + [(None, 1, 0), (5, None, None), (6, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages_pass_columns_through_and_keep_rows_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {repr(tuple(r)) for r in docs.collect()}
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in NAMES.split(", ")]
        found = [repr(tuple(r)) for r in docs.collect()]
        assert set(found) <= before and found
        before = set(found)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {200, 201, 202} & set(ids)  # no letter, no language
    assert not {205, 206} & set(ids) or 3 not in ids


def test_run_packs_what_the_stages_keep(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    kept = packed.select("doc_id").distinct().count()
    assert kept == packed.filter("piece = 0").count() > 0
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048


@pytest.mark.parametrize("which", ["documents", "labels", "both"])
def test_empty_tables(spark, folder, tmp_path, which):
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if which in (name, "both") else df).write.parquet(f"{tmp_path}/{name}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # without labels nothing is learned, every text scores one half and stays
    assert (packed.count() > 0) == (which == "labels")
