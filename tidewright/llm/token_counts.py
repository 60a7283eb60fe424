"""Token counts behind a digest cache.

Content and tokenizer version are reduced to digests; stored counts join on
them, each distinct content that the cache lacks is encoded once, and the new
counts are appended to the cache.  Documents are matched to counts by digest
only, so texts cross one shuffle: that of the misses to their encoders.  A
content with very many copies is looked up in a broadcast of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, version_digest
from .store import keep, look_up, shared_folder, slices

CACHE = "digest binary, tokenizer string, n_tokens long"


def content_digest(text: str | Column = "text") -> Column:
    """SHA-256 of the whole text.  The one normalisation that keeps every count is null to empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; a missing path is an empty cache."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``digest, n_tokens``, a row per digest of ``texts(digest, text)``; one that repeats in a partition is encoded once."""

    def run(batches):
        counts, seen = encoder(tokenizer_path).counts, set()
        for batch in slices(batches):
            new = {d: t for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()) if d not in seen}
            seen.update(new)
            n = pa.array(counts(list(new.values())), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), n], ["digest", "n_tokens"])

    counted = texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    return counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def cache_folder(spark: SparkSession, tokenizer_path: str) -> str:
    """The cache of one tokenizer version: always the same path in the shared folder."""
    return f"{shared_folder(spark)}/token-cache/{version_digest(tokenizer_path)[:32]}"


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_bytes, n_tokens``, one row per input row.

    Null and empty texts count 0 tokens and 0 bytes.  Repeated rows are encoded
    once and all returned, null doc_ids too.  The cache is append-only Parquet;
    where two runs append one digest, both hold the same count and one is read.
    A second call with the same contents encodes nothing.  Other columns of
    ``docs`` are not read.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("digest"))
    rows = keep(rows, "digests")  # texts are hashed once
    contents = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Only wanted digests meet the cache; of the cache, only the rows that they hit are aggregated.
    stored = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    wanted = keep(contents.join(stored, "digest", "left").groupBy("digest", "rep", "copies").agg(F.max("n_tokens").alias("n_tokens")), "wanted")
    misses = wanted.where("n_tokens IS NULL")
    counts = wanted
    if not misses.isEmpty():
        # One row stands for each content: (digest, smallest doc_id) spreads evenly however many copies there are.
        of = misses.select(F.col("digest").alias("of_digest"), F.col("rep").alias("of_doc"))
        texts = docs.select("doc_id", content_digest(text).alias("digest"), text.alias("text"))
        same = (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
        new = encode_counts(texts.join(of, same, "left_semi"), tokenizer_path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
        new = keep(new, "new-counts")
        new.write.mode("append").parquet(cache_path)
        found = misses.drop("n_tokens").join(new.select("digest", "n_tokens"), "digest")
        counts = keep(wanted.where("n_tokens IS NOT NULL").unionByName(found), "counts")
    return look_up(rows, counts.select("digest", "copies", "n_tokens"), "digest", "copies", F.col("doc_id")).drop("digest")
