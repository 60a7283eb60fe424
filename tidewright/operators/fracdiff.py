"""Fractional differencing and the feature table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import convolved
from ..functions.series import PART, Chunks


def weights(d: float, size: int) -> np.ndarray:
    """The first coefficients of (1 - x) ** d: running products of (k - 1 - d) / k."""
    k = np.arange(1, size)
    return np.cumprod(np.r_[1.0, (k - 1 - d) / k])


def weights_ffd(d: float, thres: float = 1e-4) -> np.ndarray:
    """The coefficients before the first whose size is under ``thres``."""
    size = 64
    while True:
        w = weights(d, size)
        under = np.abs(w) < thres
        if under.any():
            return w[: int(under.argmax())]
        size *= 4


def weight_table(degrees: DataFrame, size: int) -> DataFrame:
    """``d, k, w`` for every row of ``degrees(d)``, by a fold over k inside Spark."""
    ratio = lambda w, k: F.element_at(w, -1) * (k - 1 - F.col("d")) / k
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), F.array(F.lit(1.0)), lambda w, k: F.array_append(w, ratio(w, k)))
    return degrees.select("d", F.posexplode(folded).alias("k", "w"))


def _known(rows: DataFrame, columns: list[str], key: str, ts: str, ranges: int | None) -> tuple[Chunks, DataFrame, dict]:
    """Chunks, their rows with the last known value ``_<column>`` of each column, and the chunks of longer codes.

    A value that is known before a chunk begins enters it.
    """
    chunks = Chunks(rows.select(key, ts, *columns), [key], [ts], ranges)
    linked = chunks.linked(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).cast("double").alias(c) for c in columns])
    facts = []
    for k, parts in linked.items():
        held = [None] * len(columns)
        for part in parts:
            facts.append((*k, part[PART], *held))
            held = [h if part[c] is None else part[c] for h, c in zip(held, columns)]
    rows = chunks.rows
    entering = {c: F.lit(None) for c in columns}
    if facts:
        rows = chunks.meet(rows, chunks.table(facts, ", ".join([f"{PART} int", *(f"_in_{c} double" for c in columns)])), how="left")
        entering = {c: F.col(f"_in_{c}") for c in columns}
    last = lambda c: F.coalesce(F.last(F.col(c).cast("double"), ignorenulls=True).over(chunks.window().rowsBetween(Window.unboundedPreceding, 0)), entering[c])
    return chunks, rows.select(*chunks.id, ts, *columns, *[last(c).alias(f"_{c}") for c in columns]), linked


def _schema(chunks: Chunks, columns: list[str]) -> str:
    kind = {f.name: f.dataType.simpleString() for f in chunks.rows.schema}
    return ", ".join([*(f"{c} {kind[c]}" for c in (*chunks.keys, *chunks.order)), *(f"fd_{c} double" for c in columns)])


def frac_diff_ffd(
    bars: DataFrame, columns: list[str], d: float = 0.5, thres: float = 1e-4, key: str = "code", ts: str = "ts", ranges: int | None = None
) -> DataFrame:
    """``code, ts, fd_<column>``: fixed-width weighted sums of the last known values; rows without one go.

    A chunk borrows the rows before it that its first window covers.
    """
    w = weights_ffd(d, thres)
    chunks, rows, linked = _known(bars, columns, key, ts, ranges)
    rows = rows.withColumns({"_rn": F.row_number().over(chunks.window()), "_own": F.lit(True)})
    pairs = []
    for k, parts in linked.items():
        for q in range(1, len(parts)):
            wanted = len(w) - 1
            for p in range(q - 1, -1, -1):
                pairs.append((*k, parts[p][PART], parts[q][PART], parts[p]["n"] - wanted))
                wanted -= parts[p]["n"]
                if wanted <= 0:
                    break
    if pairs:
        lent = chunks.meet(rows, chunks.table(pairs, "p int, q int, after long"), "p").where("_rn > after")
        lent = lent.withColumns({PART: F.col("q"), "_own": F.lit(False)}).drop("q", "after")
        rows = rows.unionByName(lent)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts)
        out = {key: frame[key], ts: frame[ts]}
        for c in columns:
            x, value = frame[f"_{c}"].to_numpy(float), np.full(len(frame), np.nan)
            known = np.flatnonzero(~np.isnan(x))
            begin = known[0] if len(known) else len(x)
            if len(x) - begin >= len(w):
                value[begin + len(w) - 1 :] = np.convolve(x[begin:], w, "valid")
            value[~np.isfinite(frame[c].to_numpy(float))] = np.nan
            out[f"fd_{c}"] = value
        return pd.DataFrame(out)[frame["_own"].to_numpy(bool)].dropna(subset=[f"fd_{c}" for c in columns])

    return rows.groupBy(*chunks.id).applyInPandas(run, _schema(chunks, columns))


def unsettled(d: float, n: int, thres: float) -> int:
    """Of ``n`` values, the first ones whose weights lack more than ``thres`` of all weight."""
    size = np.abs(weights(d, n))
    return int((1 - (np.cumsum(size) - size) / size.sum() > thres).sum())


def frac_diff(
    bars: DataFrame, columns: list[str], d: float = 0.5, thres: float = 0.01, key: str = "code", ts: str = "ts", ranges: int | None = None
) -> DataFrame:
    """Expanding window: all earlier values count; rows before the weights' share settles go.

    A code's values are one array a chunk.  A chunk's sums are those over its own
    values and over each earlier chunk's, added up one after another: overlap-add
    by Fourier transforms, with a task for every chunk.
    """
    chunks, rows, linked = _known(bars, columns, key, ts, ranges)
    clock = rows.schema[ts].dataType.simpleString() == "timestamp"
    if clock:
        rows = rows.withColumn(ts, F.unix_micros(ts))  # pandas has no lists of times
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*columns, *(f"_{c}" for c in columns)]
    arrays = ", ".join([f"{key} {kind[key]}, {PART} int, {ts} array<{kind[ts]}>", *(f"{c} array<double>" for c in names)])

    chunk = chunks.id

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts)
        return pd.DataFrame({c: [frame[c].iloc[0]] for c in chunk} | {ts: [frame[ts].tolist()]} | {c: [frame[c].to_numpy(float)] for c in names})

    held = rows.groupBy(*chunks.id).applyInPandas(gather, arrays)
    pairs = []
    for k, parts in linked.items():
        before = [0, *np.cumsum([p["n"] for p in parts]).tolist()]
        pairs += [(*k, a[PART], b[PART], before[j] - before[i], before[i], before[-1]) for j, b in enumerate(parts) for i, a in enumerate(parts[: j + 1])]
    facts = chunks.table(pairs, "p int, q int, gap long, place long, total long")
    each = chunks.meet(held, facts, "p", "left")
    own = F.coalesce(F.col("gap"), F.lit(0)) == 0
    each = each.select(
        F.coalesce("q", PART).alias("q"), F.coalesce("gap", F.lit(0)).alias("gap"), F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("total", F.size(ts)).alias("total"),
        F.when(own, F.col(ts)).alias(ts), key, *[F.when(own, F.col(c)).alias(c) for c in columns], *[f"_{c}" for c in columns],
    )

    def run(frames):
        waiting = []  # earlier chunks of the chunk that follows
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.gap:
                    waiting.append(row)
                    continue
                out = {key: row[5], ts: list(row[4])}
                n = len(out[ts])
                for i, c in enumerate(columns):
                    sums, begin, raw = np.zeros(n), None, np.asarray(row[6 + i], float)
                    for r in (*waiting, row):
                        x = np.asarray(r[6 + len(columns) + i], float)
                        known = np.flatnonzero(~np.isnan(x))
                        if len(known):
                            begin = r.place + int(known[0]) if begin is None else begin
                            low = max(0, r.gap - len(x) + 1)  # the nearest lag between the two chunks
                            w = weights(d, r.gap + n)[low:]
                            sums += convolved(np.nan_to_num(x), w)[r.gap - low : r.gap - low + n]
                    if begin is None:
                        sums[:] = np.nan
                    else:
                        sums[: max(0, begin + unsettled(d, row.total - begin, thres) - row.place)] = np.nan
                    sums[~np.isfinite(raw)] = np.nan
                    out[f"fd_{c}"] = sums
                waiting = []
                yield pd.DataFrame(out).dropna(subset=[f"fd_{c}" for c in columns])

    dealt = each.repartition("q", key).sortWithinPartitions("q", key, F.desc("gap"))
    out = dealt.mapInPandas(run, f"{key} {kind[key]}, {ts} {kind[ts]}, " + ", ".join(f"fd_{c} double" for c in columns))
    return out.withColumn(ts, F.timestamp_micros(ts)) if clock else out


def sample_features(events: DataFrame, bins: DataFrame, features: DataFrame, key: str = "code", ts: str = "ts") -> DataFrame:
    """Events, labels and features on the same bar; rows with a gap go."""
    rows = events.select(key, "t0").join(bins, [key, "t0"]).join(features.withColumnRenamed(ts, "t0"), [key, "t0"])
    return rows.dropna()


def stack(tables: list[DataFrame]) -> DataFrame:
    """The tables of several codes in one."""
    return reduce(DataFrame.unionByName, tables)
