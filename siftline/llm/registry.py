"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from siftline.llm import chat, html, jaccard, language, mixing, neardup_vectors, packing, ppm, quality, urls
from siftline.llm.common import small_batches


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bounded(q) for name, q in _QUERIES.items()}


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_chat": chat.op2_chat,
    "op3_urls": urls.op3_urls,
    "op4_ppm": ppm.op4_ppm,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_language": language.op6_language,
    "op7_packing": packing.op7_packing,
    "op8_vectors": neardup_vectors.op8_vectors,
    "op9_mixing": mixing.op9_mixing,
    "op10_html": html.op10_html,
    "pipeline": corpus_pipeline.run,
}


def oracle_sql() -> dict[str, str]:
    sql = {"op2_chat": chat.oracle(), "op3_urls": urls.oracle(), "op5_jaccard": jaccard.oracle(), "op8_vectors": neardup_vectors.oracle()}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
