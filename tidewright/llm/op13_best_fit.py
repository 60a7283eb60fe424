"""Query op13: all ``documents`` packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import cut, placed

NAME = "op13_best_fit"
SQL = None  # SQL has no tokenizer; the tests compare with the library and with one-by-one best fit


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = rows.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))  # ids stay where they are
    return digests.join(placed(rows), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
