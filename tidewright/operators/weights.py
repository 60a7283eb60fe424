"""Sample weights of overlapping labels, and sequential bootstrap."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import draw_sequential, mean_uniqueness


def _numbered(bars: DataFrame, key: str, ts: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(ts)
    return bars.select(key, ts, "close", F.row_number().over(order).cast("long").alias("pos"))


def concurrency(bars: DataFrame, events: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, ts, c``: events with t0 <= ts <= t1 at every bar (a null t1 reaches the end).

    +1 at t0 and -1 after t1, summed in time order: no interval join.
    """
    starts = events.groupBy(key, F.col("t0").alias(ts)).agg(F.count("*").alias("begin"))
    ends = events.where("t1 IS NOT NULL").groupBy(key, F.col("t1").alias(ts)).agg(F.count("*").alias("end"))
    rows = bars.select(key, ts).join(starts, [key, ts], "left").join(ends, [key, ts], "left")
    order = Window.partitionBy(key).orderBy(ts)
    begun = F.sum(F.coalesce("begin", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ended = F.coalesce(F.sum(F.coalesce("end", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(key, ts, (begun - ended).alias("c"))


def _prefix(bars: DataFrame, events: DataFrame, value, key: str, ts: str) -> DataFrame:
    """Events with the sum ``s`` and the number ``n`` of the bars in [t0, t1], from prefix sums."""
    order = Window.partitionBy(key).orderBy(ts)
    rows = bars.select(key, ts, "close").join(concurrency(bars, events, key, ts), [key, ts])
    rows = rows.withColumn("x", value(order)).withColumns(
        {"upto": F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)), "pos": F.row_number().over(order)}
    )
    group = Window.partitionBy(key)
    rows = rows.withColumns({"all": F.sum("x").over(group), "last": F.max("pos").over(group)})
    begin = rows.select(key, F.col(ts).alias("t0"), (F.col("upto") - F.col("x")).alias("before"), F.col("pos").alias("pos0"), "all", "last")
    end = rows.select(key, F.col(ts).alias("t1"), F.col("upto").alias("through"), F.col("pos").alias("pos1"))
    joined = events.join(begin, [key, "t0"]).join(end, [key, "t1"], "left")
    s = F.coalesce("through", "all") - F.col("before")
    return joined.select(*[F.col(c) for c in events.columns], s.alias("s"), (F.coalesce("pos1", "last") - F.col("pos0") + 1).alias("n"))


def avg_uniqueness(bars: DataFrame, events: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``tw``: the mean of 1 / concurrency over the event's bars."""
    inverse = lambda _: F.when(F.col("c") > 0, 1 / F.col("c")).otherwise(0.0)
    rows = _prefix(bars, events, inverse, key, ts)
    return rows.withColumn("tw", F.col("s") / F.col("n")).drop("s", "n")


def return_weights(bars: DataFrame, events: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``w``: the absolute sum of log returns, each divided by its bar's concurrency."""

    def share(order):
        move = F.log("close") - F.log(F.lag("close").over(order))
        return F.coalesce(F.when(F.col("c") > 0, move / F.col("c")), F.lit(0.0))

    return _prefix(bars, events, share, key, ts).withColumn("w", F.abs("s")).drop("s", "n")


def normalise(rows: DataFrame, column: str = "w", key: str = "code") -> DataFrame:
    """Weights of each code scaled to sum to its number of rows."""
    group = Window.partitionBy(key)
    return rows.withColumn(column, F.try_divide(F.col(column) * F.count("*").over(group), F.sum(column).over(group)))


def time_decay(rows: DataFrame, c: float = 0.5, key: str = "code", ts: str = "t0") -> DataFrame:
    """Adds ``decay``: linear in the cumulative uniqueness, 1 at the newest, not below 0."""
    order = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("tw").over(Window.partitionBy(key))
    slope = (1 - c) / total if c >= 0 else 1 / ((c + 1) * total)
    return rows.withColumn("decay", F.greatest(F.lit(0.0), 1 - slope * total + slope * F.sum("tw").over(order)))


def spans(bars: DataFrame, events: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, t0, first, last``: numbers of the first and the last bar of each event."""
    rows = _numbered(bars, key, ts)
    end_of = rows.groupBy(key).agg(F.max("pos").alias("_end"))
    begin, end = rows.select(key, F.col(ts).alias("t0"), F.col("pos").alias("first")), rows.select(key, F.col(ts).alias("t1"), F.col("pos").alias("_b"))
    found = events.select(key, "t0", "t1").join(begin, [key, "t0"]).join(end, [key, "t1"], "left").join(end_of, key)
    return found.select(key, "t0", "first", F.coalesce("_b", "_end").alias("last"))


def indicator_long(bars: DataFrame, events: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, t0, pos``: the bars inside each event, sparse."""
    return spans(bars, events, key, ts).select(key, "t0", F.explode(F.sequence("first", "last")).alias("pos"))


def ind_uniqueness(indicator: DataFrame, bars: DataFrame, only_active: bool = False, key: str = "code") -> DataFrame:
    """``code, t0, u``: the mean of indicator / (row sum + 0.001) over all bars, or over the event's own."""
    sums = indicator.groupBy(key, "pos").agg(F.count("*").alias("c"))
    n = bars.groupBy(key).agg(F.count("*").alias("n_bars"))
    rows = indicator.join(sums, [key, "pos"]).groupBy(key, "t0").agg(F.sum(1 / (F.col("c") + 0.001)).alias("s"), F.count("*").alias("own"))
    return rows.join(n, key).select(key, "t0", (F.col("s") / (F.col("own") if only_active else F.col("n_bars"))).alias("u"))


def _seed(code) -> int:
    """The same for one code on every machine, whatever its type."""
    return zlib.crc32(str(code).encode())


def seq_bootstrap(bars: DataFrame, events: DataFrame, seed: int = 0, draws: int | None = None, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, draw, t0``: a sequential bootstrap of each code's events (one task per code; bounded by ``draws``)."""
    table = spans(bars, events, key, ts)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t0").reset_index(drop=True)
        rng = np.random.default_rng([seed, _seed(frame[key].iloc[0])])
        drawn = draw_sequential(frame["first"].to_numpy(), frame["last"].to_numpy(), draws or len(frame), rng)
        return pd.DataFrame({key: frame[key].iloc[0], "draw": np.arange(len(drawn)), "t0": frame["t0"].to_numpy()[drawn]})

    kind = {f.name: f.dataType.simpleString() for f in table.schema}
    return table.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, draw long, t0 {kind['t0']}")


def bootstrap_mc(bars: DataFrame, events: DataFrame, iters: int = 10, seed: int = 0, draws: int | None = None, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, iter, standard, sequential``: mean uniqueness of a uniform and of a sequential bootstrap."""
    rounds = bars.sparkSession.range(iters).withColumnRenamed("id", "iter")
    table = spans(bars, events, key, ts).join(F.broadcast(rounds))  # ``iters`` rows

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t0")
        first, last = frame["first"].to_numpy(), frame["last"].to_numpy()
        code, k = frame[key].iloc[0], int(frame["iter"].iloc[0])
        rng = np.random.default_rng([seed, k, _seed(code)])
        n = draws or len(frame)
        plain = mean_uniqueness(first, last, rng.integers(0, len(first), n))
        return pd.DataFrame({key: [code], "iter": [k], "standard": [plain], "sequential": [mean_uniqueness(first, last, draw_sequential(first, last, n, rng))]})

    kind = table.schema[key].dataType.simpleString()
    return table.groupBy(key, "iter").applyInPandas(run, f"{key} {kind}, iter long, standard double, sequential double")


def bootstrap_rows(bins: DataFrame, drawn: DataFrame, key: str = "code") -> DataFrame:
    """The rows of the events that were drawn, once each."""
    return bins.join(drawn.select(key, "t0").distinct(), [key, "t0"], "left_semi")
