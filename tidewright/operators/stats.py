"""Back-test statistics, trades from signals, and the trading-rule grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import grid_sums
from ..functions.series import PART, Chunks


def _order(key: str, ts: str):
    return Window.partitionBy(key).orderBy(ts)


def bet_times(positions: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """Times at which a bet ends: flat after a position, a change of sign, or the last bar."""
    order = _order(key, ts)
    rows = positions.withColumns({"prev": F.lag("pos").over(order), "next": F.lead(ts).over(order)})
    ends = ((F.col("pos") == 0) & (F.col("prev") != 0)) | (F.col("pos") * F.col("prev") < 0) | F.col("next").isNull()
    return rows.where(ends).select(key, ts)


MAP = ("a", "b", "c", "k", "den")  # of an entry time e: a * e + b after some bars, whose holding times sum to c + k * e, over den


def _map(**parts: Column) -> Column:
    return F.struct(*[parts[n].cast("double").alias(n) for n in MAP])


def _then(m: Column, n: Column) -> Column:
    """Map ``m`` and then ``n``."""
    return _map(a=n["a"] * m["a"], b=n["a"] * m["b"] + n["b"], c=m["c"] + n["c"] + n["k"] * m["b"], k=m["k"] + n["k"] * m["a"], den=m["den"] + n["den"])


def _folded(rows: DataFrame, by: list[str], order: str, step, columns: list[str]) -> DataFrame:
    """``by, m``: the maps of a group's rows one after another."""
    nothing = _map(a=F.lit(1), b=F.lit(0), c=F.lit(0), k=F.lit(0), den=F.lit(0))
    group = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("s"))
    return group.select(*by, F.aggregate("s", nothing, step).alias("m"))


def holding_period(positions: DataFrame, key: str = "code", ts: str = "ts", ranges: int | None = None, block: int = 1024) -> DataFrame:
    """``code, days``: weighted mean holding time with a running average entry time.

    Growing a position takes the entry time to a weighted mean, a flip sets it
    anew, anything else leaves it: each bar is an affine map of the entry time,
    and so are bars in a row.  ``block`` bars are folded into one map, a chunk's
    blocks into one, and a code's chunks into one, so no group holds a code's bars.
    """
    chunks = Chunks(positions.select(key, ts, F.col("pos").cast("double").alias("pos")), [key], [ts], ranges)
    before = [(*k, b[PART], a["last"]) for k, parts in chunks.linked(F.max_by("pos", ts).alias("last")).items() for a, b in zip(parts, parts[1:])]
    rows, entering = chunks.rows, F.lit(0.0)
    if before:
        rows, entering = chunks.meet(rows, chunks.table(before, f"{PART} int, _in double"), how="left"), F.coalesce("_in", F.lit(0.0))
    rows = rows.select(
        key, PART, ts, "pos", F.unix_date(F.col(ts).cast("date")).cast("double").alias("day"), F.coalesce(F.lag("pos").over(chunks.window()), entering).alias("prev"),
        F.floor((F.row_number().over(chunks.window()) - 1) / block).alias("block"),
    )

    def bar(m: Column, x: Column) -> Column:
        day, pos, prev = x["day"], x["pos"], x["prev"]
        delta = pos - prev
        grows, flip = delta * prev >= 0, pos * prev < 0
        old = F.when(grows & (pos != 0), prev / F.nullif(pos, F.lit(0.0))).when(flip & ~grows, 0.0).otherwise(1.0)
        new = F.when(grows & (pos != 0), day * delta / F.nullif(pos, F.lit(0.0))).when(flip & ~grows, day).otherwise(0.0)
        amount = F.when(grows, 0.0).when(flip, F.abs(prev)).otherwise(F.abs(delta))
        return _map(a=m["a"] * old, b=m["b"] * old + new, c=m["c"] + (day - m["b"]) * amount, k=m["k"] - m["a"] * amount, den=m["den"] + amount)

    join = lambda m, x: _then(m, x["m"])
    blocks = _folded(rows, [key, PART, "block"], ts, bar, ["day", "pos", "prev"])
    parts = _folded(blocks, [key, PART], "block", join, ["m"])
    whole = _folded(parts, [key], PART, join, ["m"])
    return whole.select(key, F.try_divide(F.col("m.c"), F.col("m.den")).alias("days"))


def hhi(returns: DataFrame, key: str = "code", column: str = "ret") -> DataFrame:
    """Concentration of returns, from 0 (even) to 1; null for two or fewer."""
    r = F.col(column)
    rows = returns.groupBy(key).agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))
    share = F.try_divide(F.col("q"), F.col("s") * F.col("s"))
    return rows.select(key, F.when(F.col("n") > 2, (share - 1 / F.col("n")) / (1 - 1 / F.col("n"))).alias("hhi"))


def drawdown(pnl: DataFrame, dollars: bool = False, key: str = "code", ts: str = "ts", value: str = "pnl") -> DataFrame:
    """``code, hwm, ts, dd, tuw``: each high-water mark with a fall, its depth, and the years to the next one."""
    high = F.max(value).over(_order(key, ts).rowsBetween(Window.unboundedPreceding, 0))
    rows = pnl.withColumn("hwm", high).groupBy(key, "hwm").agg(F.min(value).alias("low"), F.min(ts).alias(ts))
    rows = rows.where("hwm > low")
    depth = F.col("hwm") - F.col("low") if dollars else 1 - F.col("low") / F.col("hwm")
    years = F.date_diff(F.lead(ts).over(_order(key, ts)), F.col(ts)) / 365.2425
    return rows.select(key, "hwm", ts, depth.alias("dd"), years.alias("tuw"))


def flip_trades(signals: DataFrame, commission: float = 0.001, cash: float = 100_000.0, key: str = "code", ts: str = "ts") -> DataFrame:
    """Trades of a strategy that is long after +1 and short after -1, from ``signals(code, ts, open, close, signal)``.

    A change at a bar trades at the next bar's open; the last trade closes at
    the last close.  ``size`` is signed, whole units of the cash; ``ret`` is
    after commission on both sides.
    """
    order = _order(key, ts)
    side = F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = signals.withColumns({"side": side, "next_open": F.lead("open").over(order), "next_ts": F.lead(ts).over(order)})
    rows = rows.withColumn("was", F.lag("side").over(order))
    last = F.max_by("close", ts).over(Window.partitionBy(key))
    rows = rows.withColumns({"final": last, "final_ts": F.max(ts).over(Window.partitionBy(key))})
    turns = rows.where("side IS NOT NULL AND (was IS NULL OR was <> side) AND next_open IS NOT NULL")
    turns = turns.withColumns({"exit_price": F.coalesce(F.lead("next_open").over(order), "final"), "exit_ts": F.coalesce(F.lead("next_ts").over(order), "final_ts")})
    number = F.row_number().over(order).cast("long")
    size = F.floor(F.lit(cash) / F.col("next_open")) * F.col("side")
    gross = (F.col("exit_price") - F.col("next_open")) / F.col("next_open") * F.col("side")
    fee = F.lit(commission) * (1 + F.col("exit_price") / F.col("next_open"))
    return turns.select(
        key, number.alias("trade_id"), F.col("next_ts").alias("entry_ts"), "exit_ts", F.col("next_open").alias("entry_price"), "exit_price", size.alias("size"), (gross - fee).alias("ret")
    )


def equity_returns(equity: DataFrame, key: str = "code", ts: str = "ts", value: str = "equity") -> DataFrame:
    return equity.withColumn("ret", F.col(value) - F.lag(value).over(_order(key, ts)))


def twrr(trades: DataFrame, mode: str = "linked", key: str = "code") -> DataFrame:
    """Time-weighted return of each code's trades; ``recurrence`` is x <- x * (1 + r) - 1 from 1, in trade order."""
    r = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * F.signum("size")
    if mode == "linked":
        return trades.groupBy(key).agg((F.product(1 + r) - 1).alias("twrr"))
    rows = trades.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("trade_id", r.alias("r")))).alias("s"))
    return rows.select(key, F.aggregate("s", F.lit(1.0), lambda x, t: x * (1 + t["r"]) - 1).alias("twrr"))


def rule_grid(events: DataFrame, bars: DataFrame, grid: list[tuple[float, float]], max_hold: int, key: str = "code", ts: str = "ts") -> DataFrame:
    """``pt, sl, mean, std, sharpe, paths``: each rule's exits over the price paths after the events.

    A path leaves at the first move above pt or below -sl, or after ``max_hold``
    bars.  A path's running extremes say when it first passes each barrier, so it
    is looked at once per sorted barrier and not once per rule: a barrier that it
    passes first decides a whole run of rules.  Tasks send sums of rules only.
    """
    ahead = _order(key, ts).rowsBetween(1, max_hold)
    paths = bars.select(key, F.col(ts).alias("t0"), F.col("close").alias("p0"), F.collect_list("close").over(ahead).alias("path"))
    paths = events.select(key, "t0").join(paths, [key, "t0"]).where(F.size("path") > 0)
    moves = paths.select(F.transform("path", lambda p: p - F.col("p0")).cast("array<double>").alias("moves"))
    takes, stops = sorted({pt for pt, _ in grid}), sorted({sl for _, sl in grid})

    def run(frames):
        total = np.zeros((3, len(takes), len(stops)))
        for frame in frames:
            if len(frame):
                total += grid_sums(frame["moves"].tolist(), np.array(takes, float), np.array(stops, float))
        nodes = [(pt, sl, *total[:, i, j]) for i, pt in enumerate(takes) for j, sl in enumerate(stops)]
        yield pd.DataFrame(nodes, columns=["pt", "sl", "n", "s", "ss"])

    sums = moves.mapInPandas(run, "pt double, sl double, n double, s double, ss double").groupBy("pt", "sl")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).where("n > 0")
    wanted = bars.sparkSession.createDataFrame([(float(a), float(b)) for a, b in grid], "pt double, sl double")
    mean = F.col("s") / F.col("n")
    out = wanted.join(sums, ["pt", "sl"]).select(
        "pt", "sl", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), F.col("n").cast("long").alias("paths")
    )
    return out.withColumn("sharpe", F.try_divide("mean", "std"))
