"""What the operators share: tables in the shared folder, small batches, joins with hot keys."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import Scratch, keep, shared_folder, shared_path

__all__ = ["HOT_KEYS", "Scratch", "arrow_rows", "keep", "look_up", "shared_folder", "shared_path", "slices"]

HOT_KEYS = 1000  # a key with over 1 / HOT_KEYS of all rows is broadcast: fewer than HOT_KEYS keys


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 512):
    """Small Arrow batches for the jobs that run inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches, rows: int = 512):
    """Arrow batches in pieces: a worker's memory follows a few texts (a batch has 64 MB at most)."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        del batch
        pa.default_memory_pool().release_unused()  # a worker that is used again starts the next batch small


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str, spread: Column) -> DataFrame:
    """``rows`` left-joined on ``key`` to ``table``, which has a row per key and says in ``n`` how many rows hold it.

    Keys that hold over 1 / HOT_KEYS of all rows are fewer than HOT_KEYS, whatever
    the input: they are broadcast, and their rows go to tasks by ``spread``.  All
    others meet in an equi-join.  ``table`` should be a kept one; ``n`` is dropped.
    """
    values = [c for c in table.columns if c not in (key, n)]
    total = table.agg(F.sum(n)).first()[0] or 0
    renamed = table.select(F.col(key).alias("_key"), F.col(n).alias("_n"), F.struct(*values).alias("_cold"))
    hot = renamed.where(F.col("_n") * HOT_KEYS > total).select(F.col("_key").alias("_hot_key"), F.col("_cold").alias("_hot"))
    rest = renamed.where(F.col("_n") * HOT_KEYS <= total).drop("_n")
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    found = found.withColumns(
        {"_of": F.when(F.col("_hot_key").isNull(), F.col(key)), "_salt": F.when(F.col("_hot_key").isNotNull(), F.xxhash64(spread)).otherwise(0)}
    )
    met = found.join(rest.withColumn("_zero", F.lit(0).cast("long")), F.col("_of").eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    return met.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values])
