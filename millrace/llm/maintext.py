"""Main text of HTML pages: boosted trees over the nodes of the document tree, decoded as a whole.

Each element that isn't inline is judged by its kind, the tokens of its attributes, its ancestors, the
text, link, tag and punctuation density of its subtree, its depth and its siblings. A dynamic program
over the tree then picks the likeliest choice in which nothing inside a dropped element is kept.
The trees are fitted on made-up pages with known main text when a query is planned; pages of the
table teach nothing, so a page's text doesn't depend on other pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.boost import Trees, fit
from millrace.llm.common import small_batches
from millrace.llm.dom import Page
from millrace.llm.mainsample import labelled

#: Made-up pages that the trees are fitted on, and their seed.
PAGES, SEED = 700, 5


@lru_cache(maxsize=2)
def trees(pages: int = PAGES, seed: int = SEED) -> Trees:
    return fit(*labelled(pages, seed))


def main_texts(sources: list[str], model: Trees) -> list[str]:
    """The main text of each page; empty for an empty page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = model.odds(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        out.append(p.text(p.decode(odds[at : at + len(p.kind)])))
        at += len(p.kind)
    return out


def main_text(source: Column, model: Trees) -> Column:
    """The main text of each page; null pages count as empty."""

    @F.arrow_udf("string")
    def extract(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sources:
            yield pa.array(main_texts([s or "" for s in batch.to_pylist()], model), pa.string())

    return extract(source)


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points of the text).

    A null or empty page, or one without main text, gives an empty text. Repeated rows are extracted
    each; other columns are not read, so clashing names do not matter.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", main_text(F.col("html"), model or trees()).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
