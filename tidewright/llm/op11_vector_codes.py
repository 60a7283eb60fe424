"""Query op11: codes of all ``embeddings``."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .code_vectors import compress
from .store import look_up

NAME = "op11_vector_codes"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


def vector_codes(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    rows = codes.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("of"))  # null labels are one
    labels = rows.groupBy("of").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    digest = sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    code = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    met = look_up(rows, labels, "of", "n", F.col("vec_id"))
    return met.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(state: str, book: str) -> str:
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda k: (p.v[k] - b.v[k]) * (p.v[k] - b.v[k])))"
    return f"""{state} AS (
  SELECT n, part, v, min(d // 64) AS far, arg_min(entry, d) AS entry FROM (
    SELECT p.n, p.part, p.v, b.entry, CAST({far} AS BIGINT) * 64 + b.entry AS d FROM parts p JOIN {book} b USING (part)
  ) GROUP BY ALL
)"""


def _updated(new: str, state: str, book: str) -> str:
    return f"""{new} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
    SELECT part, entry, list(f ORDER BY k) AS v FROM (
      SELECT part, entry, k, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS f
      FROM (SELECT part, entry, unnest(range(1, len(v) + 1)) AS k, unnest(v) AS x FROM {state}) GROUP BY ALL
    ) GROUP BY ALL
  ) m USING (part, entry)
)"""


SQL = f"""
WITH held AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT n, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM held, range(16) AS r(p)
), b0 AS (SELECT part, n - 1 AS entry, v FROM parts WHERE n <= 64),
{_assigned('s0', 'b0')},
{_updated('b1', 's0', 'b0')},
{_assigned('s1', 'b1')},
{_updated('b2', 's1', 'b1')},
{_assigned('s2', 'b2')},
c AS (
  SELECT n, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM s2 GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM held JOIN c USING (n)
"""
