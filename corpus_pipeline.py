"""A training corpus from `documents`: quality, language, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`, with those that are extra, whatever their names.

Defined results, of every stage: columns may be null in any row; a null id is an id of its own, a null source a source of
its own, and the language of a document is not read but for learning. Very long texts are taken whole. Repeated rows are
judged alike; an empty table gives no rows. What each stage does with empty texts and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import jaccard, language, mixing, packing, quality
from siftline.llm.common import read, scope, small_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list accept; null and wordless texts are not."""
    small_batches(spark)
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough of their n-grams; texts without a letter go. Of languages that explain
    equally much the first by code point counts, which changes nothing here."""
    small_batches(spark)
    return language.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, null ids last. Of repeated rows one stays, and
    so does each empty text."""
    small_batches(spark)
    return jaccard.kept_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: empty ones as often as their source's whole copies, repeated rows alike."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; an empty text is its end id alone."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("packing", sequence_packing),
]

#: Learned rules, connected components, dependent rounding and byte-pair merges are not SQL: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():  # what a stage wrote on its way goes when its result is written
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
