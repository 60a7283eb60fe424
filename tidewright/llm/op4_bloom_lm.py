"""Query op4: language-model scores of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bloom_lm import score_documents

NAME = "op4_bloom_lm"
SQL = None  # the filter has no SQL; base_score and counts are compared with plain Python in the tests


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), repeats=True)
