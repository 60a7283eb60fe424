"""Selection strategies over daily bars: returns, moving averages and trend lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import respected_lines
from ..functions.shared import keep

WINDOWS = (75, 50, 25, 10)


def _order(key: str, ts: str):
    return Window.partitionBy(key).orderBy(ts)


def _newest_first(key: str, ts: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))


def top_return(bars: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """The code with the largest last-bar return; ties keep the smallest code."""
    last = F.max_by(F.struct("close", "prev"), ts).alias("x")
    rows = bars.withColumn("prev", F.lag("close").over(_order(key, ts))).groupBy(key).agg(last)
    rate = ((F.col("x.close") - F.col("x.prev")) / F.col("x.prev")).alias("rate")
    return rows.where("x.prev IS NOT NULL").select(key, rate).orderBy(F.desc("rate"), key).limit(1)


def mean_over(value: str | Column, window: int, key: str = "code", ts: str = "ts") -> Column:
    """Trailing mean, null until ``window`` bars exist."""
    rows = _order(key, ts).rowsBetween(-(window - 1), 0)
    return F.when(F.count("*").over(rows) == window, F.avg(value).over(rows))


def moving_average(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``ma_<window>`` columns; all share one sort by code and time."""
    return bars.withColumns({f"ma_{w}": mean_over("close", w, key, ts) for w in windows})


def _by_window(bars: DataFrame, windows, key: str, ts: str) -> DataFrame:
    """The averages as rows ``window, ma`` beside each bar and its previous bar, newest first in ``rn``."""
    order = _order(key, ts)
    rows = moving_average(bars, windows, key, ts)
    before = {f"p_{w}": F.lag(f"ma_{w}").over(order) for w in windows} | {"p_low": F.lag("low").over(order)}
    third = {f"t_{w}": F.lag(f"ma_{w}", 2).over(order) for w in windows}
    rows = rows.withColumns(before | third | {"rn": _newest_first(key, ts)})
    averages = F.array(
        *[F.struct(F.lit(w).alias("window"), F.col(f"ma_{w}").alias("ma"), F.col(f"p_{w}").alias("p_ma"), F.col(f"t_{w}").alias("t_ma")) for w in windows]
    )
    return rows.select(key, ts, "open", "low", "close", "p_low", "rn", F.explode(averages).alias("w")).select("*", "w.*").drop("w")


def ma_rising(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, term: int = 3, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, window, rising``: the last ``term`` differences of the average are all positive."""
    rows = _by_window(bars, windows, key, ts).where(F.col("rn") <= term)
    up = F.coalesce(F.col("ma") - F.col("p_ma") > 0, F.lit(False))
    return rows.groupBy(key, "window").agg((F.bool_and(up) & (F.count("*") == term)).alias("rising"))


def ma_low_cross(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, term: int = 3, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, window, crosses``: in the last ``term`` bars the low crosses the average upward on an up candle."""
    rows = _by_window(bars, windows, key, ts).where(F.col("rn") <= term - 1)
    below = F.coalesce(F.col("p_low") - F.col("p_ma") <= 0, F.lit(True))
    above = F.coalesce(F.col("low") - F.col("ma") > 0, F.lit(False))
    return rows.groupBy(key, "window").agg(F.bool_or(below & above & (F.col("close") > F.col("open"))).alias("crosses"))


def ma_ranking(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, term: int = 3, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, window, rise, place`` of the codes whose average rises and whose low crosses it, best first.

    One pass: the three newest rows of each code decide, then one aggregation.
    """
    rows = _by_window(bars, windows, key, ts).where(F.col("rn") <= term)
    up = F.coalesce(F.col("ma") - F.col("p_ma") > 0, F.lit(False))
    below = F.coalesce(F.col("p_low") - F.col("p_ma") <= 0, F.lit(True))
    cross = below & F.coalesce(F.col("low") - F.col("ma") > 0, F.lit(False)) & (F.col("close") > F.col("open")) & (F.col("rn") <= term - 1)
    rise = F.max(F.when(F.col("rn") == 1, (F.col("ma") - F.col("t_ma")) / F.col("t_ma")))
    chosen = rows.groupBy(key, "window").agg((F.bool_and(up) & (F.count("*") == term)).alias("rising"), F.bool_or(cross).alias("crosses"), rise.alias("rise"))
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("rise"), key)).cast("long")
    return chosen.where("rising AND crosses").select(key, "window", "rise", place.alias("place"))


def small_peaks(bars: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, idx, ts, price`` of bars above the next bar and above the nearest earlier different high."""
    order = _order(key, ts)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.select(key, ts, "high", (F.row_number().over(order) - 1).cast("long").alias("idx"))
    rows = rows.withColumns({"next": F.lead("high").over(order), "prev": F.lag("high").over(order)})
    changed = F.when(F.col("prev") != F.col("high"), F.col("prev"))
    rows = rows.withColumn("other", F.last(changed, ignorenulls=True).over(running))
    return rows.where("high > next AND other < high").select(key, "idx", ts, F.col("high").alias("price"))


def large_peaks(peaks: DataFrame, key: str = "code") -> DataFrame:
    """Peaks that neither neighbour exceeds, and the first and last of each code, numbered by ``peak``."""
    order = Window.partitionBy(key).orderBy("idx")
    rows = peaks.withColumns({"a": F.lag("price").over(order), "b": F.lead("price").over(order)})
    rows = rows.where("a IS NULL OR b IS NULL OR (a <= price AND price >= b)").drop("a", "b")
    return rows.withColumn("peak", (F.row_number().over(order) - 1).cast("long"))


def _lines(sizes: DataFrame, peaks: DataFrame, length_limited: int, max_span: int | None, key: str) -> DataFrame:
    """Falling or flat lines between two peaks whose end is at most ``length_limited`` bars before the code's last one."""
    end = peaks.join(sizes, key).where(F.col("n_bars") - F.col("idx") <= length_limited)
    s, e = peaks.alias("s"), end.alias("e")
    near = (F.col(f"s.{key}") == F.col(f"e.{key}")) & (F.col("s.idx") < F.col("e.idx"))
    if max_span is not None:
        near = near & (F.col("e.idx") - F.col("s.idx") <= max_span)
    rate = F.try_divide(F.col("e.price") - F.col("s.price"), F.col("e.idx") - F.col("s.idx"))
    lines = s.join(e, near).select(
        F.col(f"s.{key}").alias(key),
        F.col("s.idx").alias("start_idx"),
        F.col("e.idx").alias("end_idx"),
        F.col("s.price").alias("start_price"),
        F.col("e.price").alias("end_price"),
        (F.col("e.idx") - F.col("s.idx")).alias("length"),
        (F.col("e.peak") - F.col("s.peak")).alias("length_in_peaks"),
        rate.alias("line_rate"),
    )
    return lines.where("line_rate <= 0")


def candidate_lines(bars: DataFrame, length_limited: int = 40, max_span: int | None = None, key: str = "code", ts: str = "ts") -> DataFrame:
    """Falling or flat lines between two large peaks that end in the last ``length_limited`` bars.

    The pairs are pruned by their recent end and their slope before any bar is
    joined; ``max_span`` can bound the bars between their ends.
    """
    peaks = keep(large_peaks(small_peaks(bars, key, ts), key), "peaks")
    return _lines(bars.groupBy(key).agg(F.count("*").alias("n_bars")), peaks, length_limited, max_span, key)


LINE = "start_idx long, end_idx long, start_price double, end_price double, length long, length_in_peaks long, line_rate double, length_limited int, rate double, touches long"


def _respected(bars: DataFrame, settings: list[tuple[int, float]], max_span: int | None, key: str, ts: str) -> DataFrame:
    """The trend lines of every setting (length_limited, rate), with both as columns.

    A code's highs and its large peaks meet once.  Seen from a line's end, the
    line is respected if no bar in between stands at a steeper slope: the running
    maximum of slopes, back from an end, is the hull that its lines must clear,
    and answers for all starts at once.
    """
    chosen = [(int(n), float(r)) for n, r in settings]
    peaks = large_peaks(small_peaks(bars, key, ts), key)
    kind = bars.schema[key].dataType.simpleString()

    def lines_of(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        frame, marks = frame.sort_values(ts), marks.sort_values("idx")
        high, at, price = frame["high"].to_numpy(float), marks["idx"].to_numpy(), marks["price"].to_numpy(float)
        span = int(high.max() - frame["low"].min()) if len(high) else 0
        found = [line for limit, rate in chosen for line in respected_lines(high, at, price, len(high) - limit, span * rate / 100, max_span, (limit, rate))]
        out = pd.DataFrame(found, columns=[c.split()[0] for c in LINE.split(", ")])
        out.insert(0, key, frame[key].iloc[0] if len(frame) else None)
        return out

    both = bars.select(key, ts, "high", "low").groupBy(key).cogroup(peaks.select(key, "idx", "price").groupBy(key))
    found = both.applyInPandas(lines_of, f"{key} {kind}, {LINE}")
    few = F.col("touches").isin(1, 2)
    found = found.withColumns({"rule1": few & (F.col("length") + 1 >= 10), "rule1_immediate": few, "rule2": F.col("touches") > 2})
    return found.where("rule1 OR rule1_immediate OR rule2")


def trend_lines(
    bars: DataFrame, length_limited: int = 40, rate: float = 3.0, max_span: int | None = None, key: str = "code", ts: str = "ts"
) -> DataFrame:
    """Lines that every inner bar respects within the code's tolerance and that at least one inner peak touches.

    Adds ``touches`` and the flags ``rule1, rule1_immediate, rule2``; a line has
    at least one flag.
    """
    return _respected(bars, [(length_limited, rate)], max_span, key, ts).drop("length_limited", "rate")


def pick_trend_line(lines: DataFrame, key: str = "code") -> DataFrame:
    """The trend line of each selected code: the last to end, of those the last to start."""
    order = Window.partitionBy(key).orderBy(F.desc("end_idx"), F.desc("start_idx"))
    return lines.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def trend_line_sweep(bars: DataFrame, settings: list[tuple[int, float]], max_span: int | None = None, key: str = "code", ts: str = "ts") -> DataFrame:
    """Lines for several (length_limited, rate) pairs, each a method of its own, from one derivation of peaks and lines."""
    return _respected(bars, settings, max_span, key, ts)


def assemble_result(selected: DataFrame, bars: DataFrame, n: int = 0, key: str = "code", ts: str = "ts") -> DataFrame:
    """One row per method: selected codes in order of ``place``, the data's dates and the cut-off."""
    codes = F.transform(F.sort_array(F.collect_list(F.struct("place", key))), lambda x: x[key].cast("string"))
    dates = bars.agg(F.min(ts).alias("data_range_start_to_compute"), F.max(ts).alias("data_range_end_to_compute"))
    rows = selected.groupBy("method").agg(codes.alias("result_code_list"))
    return rows.join(F.broadcast(dates)).withColumn("back_test_return_date", F.lit(n))  # a row of dates


def run_strategy(bars: DataFrame, fn, schema: str | StructType, key: str = "code") -> DataFrame:
    """A user's function of one code's bars (pandas), on all codes in parallel."""
    return bars.groupBy(key).applyInPandas(fn, schema)
