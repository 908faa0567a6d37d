"""Corpus pipeline: stages of the training-data operators, one after the other over documents.

Each stage takes what its predecessor kept, written as Parquet and read again, and drops rows for good; the last one
packs what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import decontaminate, exact_dedup, langid, packing, simhash
from stowage.llm.common import table
from stowage.operators.tables import materialise, temporary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Languages that the corpus is for.
LANGUAGES = ("en", "de", "fr", "es")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no language (null, or without a letter) and those the model says are in none of LANGUAGES.

    Where the documents have no labels to learn from, every text with a letter stays. Repeated rows are judged each for
    itself; columns of any name come through; no rows give no rows.
    """
    return langid.keep_languages(docs, LANGUAGES)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of equal texts (null is empty); of repeated rows one. No rows give no rows."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near duplicates; null and empty texts are one group. No rows give no rows."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are contaminated by the benchmark; null and empty texts stay. No rows give no rows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left: pieces of texts in bins. Null and empty texts are pieces of no words; no rows give no rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("exact_dedup", exact), ("simhash", near), ("decontamination", benchmark), ("packing", pack)]

#: SQL can express neither the language model nor the fingerprints (XXH64 with a seed).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage stores for itself is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
