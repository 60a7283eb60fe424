"""Daily refresh: trades that arrive as files become finished daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_bars(trades: DataFrame, delay: str = "1 day") -> DataFrame:
    """Bars of a stream (or table) of ``code, ts, seq, price, size``; a day closes ``delay`` after its end."""
    place = F.struct("ts", "seq")
    bars = trades.withWatermark("ts", delay).groupBy("code", F.window("ts", "1 day").alias("day"))
    bars = bars.agg(
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.sum("size").alias("volume"),
    )
    return bars.select("code", F.col("day.start").cast("date").alias("ts"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Append the finished bars and stop when all files at hand are read; a nightly call goes on where the last one ended."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
