"""Query op12: ``documents`` drawn towards the n-grams of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .importance import importance_draw

NAME = "op12_importance_draw"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    drawn = importance_draw(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its bitwise definition: a table of 256 remainders, then one step a byte.
SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT CAST(i AS UINTEGER), 0, CAST(i AS UINTEGER) FROM range(256) AS r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS n, doc_id, 0 AS kind, text FROM documents
  UNION ALL SELECT row_number() OVER (), NULL, 1, text FROM benchmark
), w AS (
  SELECT n, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), g AS (
  SELECT n, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w
), c AS (SELECT n, kind, f, count(*) AS m FROM g GROUP BY ALL),
h AS (
  SELECT f, CAST(xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i - 1, 2) AS UINTEGER)),
    lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UINTEGER)), CAST(4294967295 AS UINTEGER)) AS BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM c), tab
), s AS (
  SELECT bucket, coalesce(sum(m) FILTER (kind = 0), 0) AS s, coalesce(sum(m) FILTER (kind = 1), 0) AS t FROM c JOIN h USING (f) GROUP BY bucket
), a AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM s),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s, a
), d AS (
  SELECT n, sum(m) AS n_features, sum(m * gain) AS total FROM c JOIN h USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY n
), p AS (
  SELECT n, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % n_features + n_features) % n_features)) // n_features, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN d USING (n) WHERE kind = 0
), q AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score,
    (SELECT count(*) FROM p WHERE n_words >= 20) * 25 // 100 AS drawn FROM p
), r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM r
"""
