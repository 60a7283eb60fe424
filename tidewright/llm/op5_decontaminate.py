"""Query op5: the benchmark items that ``documents`` hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminations

NAME = "op5_decontaminate"
SQL = None  # edit distance over all windows is too slow in SQL; compared with a brute-force version in the tests


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")
