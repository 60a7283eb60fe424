"""Rewards of past selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reward(selection: DataFrame, bars: DataFrame, n: int, key: str = "code", ts: str = "ts") -> DataFrame:
    """``method, code, reward_rates, reward_rate_mean`` of ``selection(method, code, data_range_end)``.

    Bought at the close of the range's end; rates of that bar and the next n - 1
    (n = -1: all strictly later bars; n = 0: none).
    """
    picks = selection.select("method", F.col(key).alias("_k"), F.col("data_range_end").cast("date").alias("_end"))
    rows = bars.join(picks, (F.col(key) == F.col("_k")) & (F.col(ts) >= F.col("_end")))
    place = Window.partitionBy("method", key).orderBy(ts)
    rows = rows.withColumns({"rn": F.row_number().over(place), "buy": F.first("close").over(place)})
    wanted = F.col(ts) > F.col("_end") if n == -1 else F.col("rn") <= n
    rate = F.struct(ts, ((F.col("close") - F.col("buy")) / F.col("buy")).alias("rate"))
    out = rows.groupBy("method", key).agg(F.array_sort(F.collect_list(F.when(wanted, rate))).alias("r"))
    rates = F.transform("r", lambda x: x["rate"])
    total = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x)
    return out.select("method", key, rates.alias("reward_rates"), F.try_divide(total, F.size("r")).alias("reward_rate_mean"))


def reward_summary(rewards: DataFrame) -> DataFrame:
    """Per method the mean of the codes' means, and winners as ``k / n``."""
    winners = F.concat(F.count_if(F.col("reward_rate_mean") > 0).cast("string"), F.lit(" / "), F.count("*").cast("string"))
    return rewards.groupBy("method").agg(F.avg("reward_rate_mean").alias("reward_rate_mean_in_method"), winners.alias("count_winner_brand"))
