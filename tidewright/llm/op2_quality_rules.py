"""Query op2: quality verdicts on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import judge_quality

NAME = "op2_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), ln AS (
  SELECT n, line FROM (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lc AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY n),
win AS (
  SELECT n, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), ws AS (SELECT n, i, array_to_string(w[i:i+4], ' ') AS s FROM win),
rep AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, s) AS c FROM ws) WHERE c > 1),
rw AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(5) AS r(k) GROUP BY n),
b AS (
  SELECT n, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN lc USING (n) LEFT JOIN rw USING (n)
), r AS (
  SELECT n, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS ratio,
    unnest([100 * word_chars // n_words, 10000 * n_symbols // n_words, 10000 * n_dup_lines // n_lines, 10000 * n_repeat_words // n_words]) AS v
  FROM b WHERE n_words > 0
), s AS (
  SELECT *, v - v % CAST(2 ** greatest(length(bin(v)) - 6, 0) AS BIGINT) AS bucket FROM r
), q AS (
  SELECT lang, source, ratio, 1 AS level, bucket, count(*) AS n FROM s GROUP BY ALL
  UNION ALL SELECT lang, NULL, ratio, 2, bucket, count(*) FROM s GROUP BY ALL
  UNION ALL SELECT NULL, NULL, ratio, 3, bucket, count(*) FROM s GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio, level ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY lang, source, ratio, level) AS docs FROM q
), f AS (
  SELECT lang, source, ratio, level, max(docs) AS docs, min(bucket) FILTER (4 * upto >= docs) AS q1, min(bucket) FILTER (4 * upto >= 3 * docs) AS q3
  FROM c GROUP BY ALL
), g AS (
  SELECT *, 3 * (q3 - q1) + CASE ratio WHEN 'word_length' THEN 100 WHEN 'symbols' THEN 500 WHEN 'dup_lines' THEN 5000 ELSE 2000 END AS reach FROM f
), own AS (
  SELECT a.lang, a.source, a.ratio,
    CASE WHEN a.docs >= 200 THEN a.q1 - a.reach WHEN l.docs >= 200 THEN l.q1 - l.reach ELSE e.q1 - e.reach END AS low,
    CASE WHEN a.docs >= 200 THEN a.q3 + a.reach WHEN l.docs >= 200 THEN l.q3 + l.reach ELSE e.q3 + e.reach END AS high
  FROM g a JOIN g l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM a.lang AND l.ratio = a.ratio
  JOIN g e ON e.level = 3 AND e.ratio = a.ratio WHERE a.level = 1
), ok AS (
  SELECT r.n, bool_and(v <= high AND (r.ratio <> 'word_length' OR v >= low)) AS inside
  FROM r JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source AND r.ratio = o.ratio GROUP BY r.n
), v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b LEFT JOIN ok USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND coalesce(inside, false) AS kept FROM v
"""
