"""Query op7: the words that a mix of all ``documents`` takes from each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .source_mix import taken_words

NAME = "op7_source_mix"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The schedule deals out each stream's first ``target`` words, so what it takes of a document follows from the stream.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, CAST(2.0 * source_size AS DOUBLE) AS most FROM s
), f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total
  FROM w
), l AS (SELECT *, (total - full_before) / open_weight AS level FROM f),
t AS (
  SELECT source, source_size, least(most, coalesce((SELECT max(level) FROM l WHERE weight * level <= most), CAST('inf' AS DOUBLE)) * weight) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(least(start + size, goal) - start, 0) + greatest(least(start + source_size + size, goal) - start - source_size, 0) AS BIGINT) AS taken FROM p
"""
