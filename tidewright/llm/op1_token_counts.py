"""Query op1: token counts of ``documents`` through a digest cache."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_counts import cache_folder, token_counts

NAME = "op1_token_counts"
LIMIT = 1024
SQL = None  # SQL has no tokenizer; the tests compare with the library


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts(docs, cache_folder(spark, vocabulary), vocabulary)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
