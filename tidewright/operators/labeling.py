"""Triple-barrier labels for all codes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import PART, Chunks
from ..functions.shared import keep
from .bars import cusum_events


def _day(ts: str) -> Column:
    return F.unix_date(F.col(ts).cast("date"))


def _lagged(chunks: Chunks, num_days: int, ts: str) -> DataFrame:
    """The chunks' rows with ``ret``, still by chunk.

    A chunk borrows the bars before it that its own bars can refer to: those of
    the ``num_days + 1`` days before its first one, and the last bar before these.
    """
    back, rows = num_days + 1, chunks.rows.withColumn("_own", F.lit(True))
    pairs = []
    for key, parts in chunks.linked(F.min("_day").alias("first")).items():
        for k in range(1, len(parts)):
            since = parts[k]["first"] - back
            for other in reversed(parts[:k]):
                pairs.append((*key, other[PART], parts[k][PART], since))
                if other["first"] <= since:
                    break
    if pairs:
        near = chunks.meet(chunks.rows, chunks.table(pairs, "p int, q int, since int"), "p")
        lent = near.where("_day > since").select(*chunks.keys, ts, "close", "_day", F.col("q").alias(PART))
        oldest = near.where("_day <= since").groupBy(*chunks.keys, "q").agg(F.max_by(F.struct(ts, "close", "_day"), ts).alias("x"))
        oldest = oldest.select(*chunks.keys, f"x.{ts}", "x.close", "x._day", F.col("q").alias(PART))
        rows = rows.unionByName(lent.unionByName(oldest).withColumn("_own", F.lit(False)))
    before = Window.partitionBy(*chunks.id).orderBy("_day").rangeBetween(Window.unboundedPreceding, -back)
    return rows.withColumn("ret", F.col("close") / F.max_by("close", ts).over(before) - 1).where("_own AND ret IS NOT NULL")


def lagged_return(bars: DataFrame, num_days: int = 1, key: str = "code", ts: str = "ts", ranges: int | None = None) -> DataFrame:
    """``code, ts, ret`` against the last bar strictly before ts - num_days: a range frame inside chunks, not a join."""
    chunks = Chunks(bars.select(key, ts, "close", _day(ts).alias("_day")), [key], [ts], ranges)
    return _lagged(chunks, num_days, ts).select(key, ts, "ret")


def daily_vol(bars: DataFrame, num_days: int = 1, span: int = 100, key: str = "code", ts: str = "ts", ranges: int | None = None) -> DataFrame:
    """``code, ts, trgt``: exponentially weighted deviation of the lagged returns, from a code's second return on.

    Sums that decay by q a bar are associative: each block of ``16 * span`` bars
    has its own, scaled by powers of q that stay in range, and a block takes over
    those of the blocks in reach before it (after ``32 * span`` bars less than
    1e-27 is left).  Only Spark's functions; a code's bars lie in many tasks.
    """
    q, block, reach = 1 - 2 / (span + 1), 16 * span, 32 * span
    chunks = Chunks(bars.select(key, ts, "close", _day(ts).alias("_day")), [key], [ts], ranges)
    power = lambda n: F.pow(F.lit(q), n)
    place = F.row_number().over(chunks.window()) - 1
    rows = _lagged(chunks, num_days, ts).select(key, ts, PART, "ret", place.alias("_i"))
    rows = rows.withColumns({"_block": F.floor(F.col("_i") / block), "_k": F.col("_i") % block})
    upto = Window.partitionBy(key, PART, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    local = lambda x: power(F.col("_k")) * F.sum(power(-F.col("_k")) * x).over(upto)
    rows = keep(rows.withColumns({"s": local(F.col("ret")), "ss": local(F.col("ret") * F.col("ret"))}).drop("ret", "_i"), "decayed")
    blocks = rows.groupBy(key, PART, "_block").agg(F.count("*").alias("n"), F.max_by("s", "_k").alias("s"), F.max_by("ss", "_k").alias("ss"))
    blocks = blocks.withColumn("end", F.sum("n").over(Window.partitionBy(key).orderBy(PART, "_block")))
    near = Window.partitionBy(key).orderBy("end").rangeBetween(-(block + reach), -1)
    blocks = blocks.withColumn("near", F.collect_list(F.struct("end", "s", "ss")).over(near)).withColumn("before", F.col("end") - F.col("n"))
    taken = lambda c: F.aggregate("near", F.lit(0.0), lambda a, x: a + power(F.col("before") - x["end"]) * x[c])
    blocks = blocks.select(F.col(key).alias("_key"), F.col(PART).alias("_p"), F.col("_block").alias("_b"), "before", taken("s").alias("_s"), taken("ss").alias("_ss"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_p")) & (F.col("_block") == F.col("_b"))
    n, old = F.col("before") + F.col("_k") + 1, power(F.col("_k") + 1)
    sums = rows.join(blocks, same).where(n > 1).select(key, ts, n.alias("n"), (F.col("s") + old * F.col("_s")).alias("s"), (F.col("ss") + old * F.col("_ss")).alias("ss"))
    w, w2 = (1 - power(F.col("n"))) / (1 - q), (1 - power(2 * F.col("n"))) / (1 - q * q)
    variance = F.greatest(F.col("ss") / w - F.pow(F.col("s") / w, F.lit(2)), F.lit(0.0)) * w * w / (w * w - w2)
    return sums.select(key, ts, F.sqrt(variance).alias("trgt"))


def _barriers(bars: DataFrame, num_days: int, key: str, ts: str) -> DataFrame:
    """``code, t0, t1, p0`` of every bar: its vertical barrier and its close, in one window pass."""
    ahead = Window.partitionBy(key).orderBy(_day(ts)).rangeBetween(num_days, Window.unboundedFollowing)
    return bars.select(key, F.col(ts).alias("t0"), F.min(ts).over(ahead).alias("t1"), F.col("close").alias("p0"))


def vertical_barrier(events: DataFrame, bars: DataFrame, num_days: int, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``t1``: the first bar at or after t0 + num_days, null past the end."""
    return events.join(_barriers(bars, num_days, key, ts).drop("p0"), [key, "t0"])


def event_targets(events: DataFrame, vol: DataFrame, min_ret: float, key: str = "code", ts: str = "ts") -> DataFrame:
    """Events whose target exceeds ``min_ret``."""
    return events.join(vol.withColumnRenamed(ts, "t0"), [key, "t0"]).where(F.col("trgt") > min_ret)


def first_touch(
    events: DataFrame, bars: DataFrame, ptsl=(1.0, 1.0), max_days: int | None = None, bucket_days: int = 16, key: str = "code", ts: str = "ts"
) -> DataFrame:
    """Adds ``pt, sl``: the first times at which the signed return passes a barrier in [t0, t1].

    Events and bars meet in an equi-join on the code and on stretches of
    ``bucket_days``: an event is in the stretches that its path crosses, so that
    it meets the bars of its path and not its code's whole history.  A path
    without a vertical barrier ends after ``max_days``, else at the code's last
    bar.  A column ``p0`` of the events is taken as their price.
    """
    columns = [c for c in events.columns if c != "p0"]
    if "p0" not in events.columns:
        events = events.join(bars.select(key, F.col(ts).alias("t0"), F.col("close").alias("p0")), [key, "t0"])
    if max_days is not None:
        rows = events.withColumn("_end", F.least("t1", F.date_add("t0", max_days).cast(bars.schema[ts].dataType)))
    else:
        last = bars.groupBy(key).agg(F.max(ts).alias("_last"))  # a row a code
        rows = events.join(last, key, "left").withColumn("_end", F.coalesce("t1", "_last")).drop("_last")
    stretch = lambda t: F.floor(_day(t) / bucket_days).cast("long")
    rows = rows.withColumn("_b", F.explode(F.sequence(stretch("t0"), F.greatest(stretch("t0"), stretch("_end")))))
    prices = bars.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col("close").alias("_p"), stretch(ts).alias("_at"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_at")) & (F.col("_t") >= F.col("t0")) & (F.col("_t") <= F.col("_end"))
    r = (F.col("_p") / F.col("p0") - 1) * F.col("side")
    none = F.lit(None).cast(bars.schema[ts].dataType)
    touch = {
        "sl": F.min(F.when(r < -ptsl[1] * F.col("trgt"), F.col("_t"))) if ptsl[1] else F.min(none),
        "pt": F.min(F.when(r > ptsl[0] * F.col("trgt"), F.col("_t"))) if ptsl[0] else F.min(none),
    }
    return rows.join(prices, inside, "left").groupBy(*columns).agg(*[c.alias(n) for n, c in touch.items()])


def get_events(
    events: DataFrame, bars: DataFrame, vol: DataFrame, ptsl=(1.0, 1.0), min_ret: float = 0.0, num_days: int | None = 5, side: DataFrame | None = None, key: str = "code", ts: str = "ts"
) -> DataFrame:
    """``code, t0, t1, trgt, side``: t1 is the first of the vertical barrier and the two touches.

    Without ``side`` (code, t0, side) the barriers are symmetric, both with the first factor.
    """
    rows = event_targets(events, vol, min_ret, key, ts)
    facts = _barriers(bars, num_days or 0, key, ts)
    if num_days is None:
        facts = facts.withColumn("t1", F.lit(None).cast(bars.schema[ts].dataType))
    rows = rows.join(facts, [key, "t0"])
    if side is None:
        rows, factors = rows.withColumn("side", F.lit(1.0)), (ptsl[0], ptsl[0])
    else:
        rows, factors = rows.join(side, [key, "t0"]), tuple(ptsl)
    touched = first_touch(rows, bars, factors, key=key, ts=ts)
    return touched.select(key, "t0", F.least("t1", "sl", "pt").alias("t1"), "trgt", "side")


def prices_at(times: DataFrame, bars: DataFrame, name: str, price: str, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``price``: the close of the first bar at or after each time ``name`` (null past the last bar).

    Times and bars are put in one order per code; a time takes the next bar from
    a frame that looks ahead, so no join compares times.
    """
    wanted = times.select(key, F.col(name).alias("_at")).distinct()
    marks = wanted.select(key, "_at", F.lit(None).cast("double").alias("_close")).unionByName(
        bars.select(key, F.col(ts).alias("_at"), F.col("close").cast("double").alias("_close"))
    )
    ahead = Window.partitionBy(key).orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.withColumn("_next", F.first("_close", ignorenulls=True).over(ahead)).where("_close IS NULL")
    found = found.select(F.col(key).alias("_key"), "_at", F.col("_next").alias(price)).distinct()
    return times.join(found, (F.col(key) == F.col("_key")) & (F.col(name) == F.col("_at")), "left").drop("_key", "_at")


def get_bins(events: DataFrame, bars: DataFrame, meta: bool = False, key: str = "code", ts: str = "ts", fill: bool = False) -> DataFrame:
    """``code, t0, t1, ret, bin`` of the events that end; meta: signed return and a bin of 0 or 1.

    Prices are those of the bars at t0 and t1.  ``fill``: a time between two bars
    takes the next bar's price, and one past the last bar has none (ret null).
    """
    ended = events.where("t1 IS NOT NULL")
    if fill:
        rows = prices_at(prices_at(ended, bars, "t0", "p0", key, ts), bars, "t1", "p1", key, ts)
    else:
        price = lambda t, p: bars.select(key, F.col(ts).alias(t), F.col("close").alias(p))
        rows = ended.join(price("t0", "p0"), [key, "t0"]).join(price("t1", "p1"), [key, "t1"])
    ret = F.col("p1") / F.col("p0") - 1
    if meta:
        ret = ret * F.col("side")
    rows = rows.select(key, "t0", "t1", ret.alias("ret"))
    return rows.withColumn("bin", (F.when(F.col("ret") > 0, 1).otherwise(0) if meta else F.signum("ret")).cast("int"))


def drop_rare_labels(bins: DataFrame, min_pct: float = 0.05, key: str = "code") -> DataFrame:
    """Drops each code's rarest label where three are present and its share is at most ``min_pct``."""
    counts = bins.groupBy(key, "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(key)
    counts = counts.withColumns({"total": F.sum("n").over(group), "labels": F.count("*").over(group)})
    counts = counts.withColumn("rn", F.row_number().over(group.orderBy("n", "bin")))
    rare = counts.where((F.col("labels") >= 3) & (F.col("rn") == 1) & (F.col("n") <= F.lit(min_pct) * F.col("total")))
    return bins.join(rare.select(key, "bin"), [key, "bin"], "left_anti")


def label(
    bars: DataFrame, h: float = 30.0, num_days: int = 5, ptsl=(0.1, 0.1), min_ret: float = 0.03, min_pct: float = 0.05, key: str = "code", ts: str = "ts"
) -> DataFrame:
    """Events, barriers and bins of all codes."""
    vol = daily_vol(bars, num_days, key=key, ts=ts)
    events = get_events(cusum_events(bars, h, key=key, ts=ts), bars, vol, ptsl, min_ret, num_days, key=key, ts=ts)
    return drop_rare_labels(get_bins(events, bars, key=key, ts=ts), min_pct, key)
