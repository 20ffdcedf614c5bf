"""A training-corpus pipeline: five stages over documents, each written and read again by the next.

Every stage but the last returns the columns of documents.  Rows without text
are rejected by the first stage; a row without doc_id stays through the
filters, whose decisions are made for (doc_id, text), and isn't packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscore.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from folioscore.llm.common import materialise, release, table


#: Word 5-gram Jaccard similarity from which documents are near copies.  Of the pairs of distinct texts in sf0.1 that
#: have a similarity of 0.3 and more, 23 lie below 0.4, in the gap between chance and copies, 30 from 0.4 to 0.45 and
#: 1,224 above; at 0.7, inside the cluster of copies, 292 of the 592 documents linked at 0.4 aren't linked.
NEAR = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose text is in none of the languages learnt from the labelled rows."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each distinct text."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by n-gram Jaccard similarity of at least NEAR."""
    return ngram_join.keep_one_of_each(docs, threshold=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows in which large sources are held back: shares go by the square root of a source's tokens."""
    return packing.pack(docs, temper=0.5)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: Bloom filters, a trained model and a tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
