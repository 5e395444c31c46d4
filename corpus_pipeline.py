"""A corpus, from raw documents to packed sequences, in four stages.

Each stage takes all documents that the one before kept and returns documents with the same columns;
the last returns the pieces of the packed sequences. Stages learn only from what they are given and
from `labels`, and hand their rows on through Parquet in the shared folder.

Null and empty texts have no letter and go in the first stage. Rows without an id are judged like
others and none stands for another; of repeated rows one stays. An empty table gives empty stages.
Columns of any name are passed through to the last stage, which reads ids and texts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, langid, packing, quality
from millrace.llm.common import discard, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that stands out; texts without a letter go, and all if no language can be learned."""
    return langid.kept(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not; all, if `labels` calls none of them good."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows without an id stay."""
    return jaccard.representatives(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; each row is packed, and an empty text is one token."""
    import public_tokenizers as vocabularies

    return packing.best_two_fit(docs, vocabularies.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        discard(docs)  # a table of the stage before; the input is left alone
        docs = kept
    packed = written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    discard(docs)
    return packed


#: Learned models and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
