"""Query op8: predicted languages of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .gru_lang import identify_languages

NAME = "op8_language_id"
SQL = None  # a trained network has no SQL; gradients and held-out accuracy are tested


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
