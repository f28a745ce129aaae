"""The queries of the corpus operators over the tables of one folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lensfold.llm import (
    decontaminate,
    embedding_dedup,
    filter_audit,
    html_text,
    language_id,
    license_scan,
    packing,
    quality,
    simhash_dedup,
    spelling_groups,
    substring_dedup,
    suffix_tree_lm,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: decontaminate.contamination_report(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op2_quality": lambda s, d: quality.quality_report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op3_lm_score": lambda s, d: suffix_tree_lm.lm_scores(_table(s, d, "documents")),
        "op4_embedding_dedup": lambda s, d: embedding_dedup.embedding_components(_table(s, d, "embeddings")),
        "op5_html_text": lambda s, d: html_text.extract(_table(s, d, "pages")),
        "op6_simhash_dedup": lambda s, d: simhash_dedup.simhash_report(_table(s, d, "documents")),
        "op7_packing": lambda s, d: packing.pack(_table(s, d, "documents")),
        "op8_url_filter": lambda s, d: url_filter.judge_urls(_table(s, d, "pages"), url_filter.rules_table(s)),
        "op9_language_id": lambda s, d: language_id.predict_languages(_table(s, d, "documents")),
        "op10_substring_dedup": lambda s, d: substring_dedup.substring_report(_table(s, d, "documents")),
        "op11_filter_audit": lambda s, d: filter_audit.filter_audit(_table(s, d, "documents"), _table(s, d, "labels")),
        "op12_license_scan": lambda s, d: license_scan.license_report(_table(s, d, "documents")),
        "op13_spelling_groups": lambda s, d: spelling_groups.spelling_report(_table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE,
        "op4_embedding_dedup": embedding_dedup.ORACLE,
        "op8_url_filter": url_filter.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_license_scan": license_scan.ORACLE,
        "op13_spelling_groups": spelling_groups.ORACLE,
    }
