"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.vptree import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from millrace.llm.bytebpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from millrace.llm.bytebpe import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from millrace.llm.packing import best_two_fit

    return best_two_fit(table(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.replytree import format_turns

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], own.schema)
    return format_turns(own.unionByName(more))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.rabitq import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.maintext import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.variants import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.katz import scored

    return scored(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from millrace.llm import sql

    return {k: v for k, v in vars(sql).items() if k[:2] == "op" and k[2:3].isdigit()}
