"""Query op3: ``documents`` as token-id files, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .store import keep, shared_path
from .token_files import read_token_files, write_token_files

NAME = "op3_token_files"
END = 2
SQL = None  # SQL has no tokenizer; the tests make an exact round trip


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_files(spark, docs)


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder, vocabulary = shared_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(keep(write_token_files(docs, folder, vocabulary, END), "manifest"))
