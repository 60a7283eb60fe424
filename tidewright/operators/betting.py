"""Bet sizes from predicted probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_cdf


def bet_signal(rows: DataFrame, k: int, step: float | None = None, side: str | None = None) -> DataFrame:
    """Adds ``signal`` from the probability ``prob`` of the predicted label ``pred`` out of k classes."""
    z = (F.col("prob") - 1.0 / k) / F.sqrt(F.col("prob") * (1 - F.col("prob")))
    signal = F.col("pred") * (2 * norm_cdf(z) - 1)
    rows = rows.withColumn("signal", signal * F.col(side) if side else signal)
    return discretise(rows, step) if step else rows


def avg_active(rows: DataFrame, key: str = "code") -> DataFrame:
    """``code, t, signal``: at each start or end the mean of the signals with t0 <= t < t1 (a null t1 never ends), 0 if none."""
    plus = rows.select(key, F.col("t0").alias("t"), F.col("signal").alias("s"), F.lit(1).alias("n"))
    minus = rows.where("t1 IS NOT NULL").select(key, F.col("t1").alias("t"), (-F.col("signal")).alias("s"), F.lit(-1).alias("n"))
    at = plus.unionByName(minus).groupBy(key, "t").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    total, active = F.sum("s").over(order), F.sum("n").over(order)
    return at.select(key, "t", F.when(active > 0, total / active).otherwise(0.0).alias("signal"))


def discretise(rows: DataFrame, step: float) -> DataFrame:
    """Signals rounded to multiples of ``step`` (half to even), within [-1, 1]."""
    return rows.withColumn("signal", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.bround(F.col("signal") / step) * step)))


def bet_size(x: Column, w: Column) -> Column:
    return x / F.sqrt(w + x * x)


def target_position(w: Column, forecast: Column, price: Column, most: Column) -> Column:
    return (bet_size(forecast - price, w) * most).cast("int")


def inverse_price(forecast: Column, w: Column, m: Column) -> Column:
    return forecast - m * F.sqrt(w / (1 - m * m))


def calibrate_w(x: Column, m: Column) -> Column:
    return x * x * (1 / (m * m) - 1)


def limit_price(target: Column, position: Column, forecast: Column, w: Column, most: Column) -> Column:
    """Mean inverse price of the bets between the position and its target; null where they agree or no bet lies between."""
    low = F.abs(position + F.signum(target - position)).cast("int")
    high = F.abs(target).cast("int")
    steps = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.lit(0.0), lambda a, j: a + inverse_price(forecast, w, j / most.cast("double")))
    return F.when((target != position) & (low <= high), total / (target - position))
