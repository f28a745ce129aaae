"""Corpus preparation from end to end: language, near copies, repeated passages, benchmark text, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. The stages are iterative or statistical, so no SQL states their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lensfold.llm import decontaminate, language_id, packing, simhash_dedup, substring_dedup
from lensfold.llm.common import save

#: A text whose n-grams are further than this from every profile (1: equal, 0: nothing in common) is in no learned language.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: without letters, or far from all profiles. Profiles are learned from ``docs``."""
    found = language_id.identify_language(docs, language_id.learn_profiles(docs))
    return found.filter((found.lang_pred != "und") & (found.score >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group."""
    return simhash_dedup.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages but for their first occurrence."""
    return substring_dedup.remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark text."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("batches", batches)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
