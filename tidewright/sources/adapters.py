"""Market-data tables derived from the star-schema tables, deterministically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars ``code, ts, open, high, low, close, volume``: a supplier's line items are its trades."""
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    step = F.round((F.col("l_discount") - 0.05) * 100)
    price = 1000 + F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    trades = items.select(
        F.col("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("ts"),
        F.col("l_quantity").alias("q"),
        F.row_number().over(order).alias("rn"),
        price.alias("px"),
    )
    return trades.groupBy("code", "ts").agg(
        F.min_by("px", "rn").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "rn").alias("close"),
        F.sum("q").alias("volume"),
    )


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "user_id") -> DataFrame:
    """Trades ``symbol, ts, seq, price, size``: the events of each user (or event type)."""
    return table(spark, sf_dir, "events").select(
        F.col(symbol).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
    )


#: The same derivations for the oracle; put after WITH.
BARS_SQL = """
px AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS ts, l_quantity AS q, row_number() OVER w AS rn,
    1000 + sum(round((l_discount - 0.05) * 100)) OVER (w ROWS UNBOUNDED PRECEDING) AS px
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)
), bars AS (
  SELECT code, ts, min_by(px, rn) AS open, max(px) AS high, min(px) AS low, max_by(px, rn) AS close, sum(q) AS volume
  FROM px GROUP BY code, ts
)"""
TICKS_SQL = """
ticks AS (
  SELECT user_id AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events
)"""
