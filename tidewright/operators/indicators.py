"""Indicators, features and the supervised data set."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import closest, first_copies
from ..functions.shared import keep
from .strategy import mean_over


def _order(key: str, ts: str):
    return Window.partitionBy(key).orderBy(ts)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``upper, lower``: the mean of (high + low + close) / 3 plus and minus k sample deviations."""
    rows = _order(key, ts).rowsBetween(-(n - 1), 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    full = F.count("*").over(rows) == n
    mean, spread = F.avg(typical).over(rows), F.stddev_samp(typical).over(rows)
    return bars.withColumns({"upper": F.when(full, mean + k * spread), "lower": F.when(full, mean - k * spread)})


def sma_features(bars: DataFrame, windows=(10, 20, 50, 100), key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``x_sma_<n>`` = (close - mean) / close and ``d_sma_<a>_<b>`` = (mean a - mean b) / close of neighbours."""
    rows = bars.withColumns({f"_m{n}": mean_over("close", n, key, ts) for n in windows})
    new = {f"x_sma_{n}": (F.col("close") - F.col(f"_m{n}")) / F.col("close") for n in windows}
    new |= {f"d_sma_{a}_{b}": (F.col(f"_m{a}") - F.col(f"_m{b}")) / F.col("close") for a, b in zip(windows, windows[1:])}
    return rows.withColumns(new).drop(*[f"_m{n}" for n in windows])


def momentum(bars: DataFrame, n: int = 2, key: str = "code", ts: str = "ts") -> DataFrame:
    return bars.withColumn("momentum", F.col("close") / F.lag("close", n).over(_order(key, ts)) - 1)


def band_features(bands: DataFrame) -> DataFrame:
    """Distances of the bands from the close, and their width, relative to the close."""
    close = F.col("close")
    return bands.withColumns(
        {"x_upper": (F.col("upper") - close) / close, "x_lower": (F.col("lower") - close) / close, "x_width": (F.col("upper") - F.col("lower")) / close}
    )


def forward_label(bars: DataFrame, n: int = 48, band: float = 0.004, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``y``: the sign of the return over the next n bars, 0 inside the band, null at the end."""
    r = F.lead("close", n).over(_order(key, ts)) / F.col("close") - 1
    return bars.withColumn("_r", r).withColumn("y", F.when(F.abs("_r") <= band, 0).otherwise(F.signum("_r")).cast("int")).drop("_r")


def calendar_features(bars: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Adds ``outside`` (not between two dates), ``day_of_week`` (Monday 0) and ``hour``."""
    outside = ~F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return bars.withColumns({"outside": outside, "day_of_week": F.weekday(ts), "hour": F.hour(ts)})


def clean_xy(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in the columns."""
    bad = reduce(operator.or_, [F.isnan(F.col(c).cast("double")) for c in columns])
    return rows.dropna(subset=columns).where(~bad)


PIVOTS = 32  # cells of the index
BLOCK, WIDE = 1 << 14, 1 << 20  # points, and queries, that a task holds at once, and their components


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, summed component by component."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return total


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as rows."""
    return np.asarray(pc.list_flatten(column), float).reshape(len(column), -1)


def _by_cell(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``far``, the distances of their vector to the pivots, and ``cell``, the nearest pivot."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = _matrix(part.column(vector))
                far = np.sqrt(_squares(x, pivots))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(far.argmin(1), pa.int32())], [*part.schema.names, "far", "cell"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("far array<double>, cell int").fields]))


def _reachable(queries: DataFrame, cells: list, pivots: np.ndarray, k: int) -> DataFrame:
    """Queries ``row, q, own, reach`` beside the ``cells`` that can hold one of their k nearest points, and the ``dists`` to those.

    ``reach`` bounds the k-th distance: from cells that are sure to hold k
    points, or the ``found`` one.  A cell is out of reach if its ball is, or the
    plane half-way between its pivot and the query's own one.
    """
    number = np.array([c["cell"] for c in cells], np.int32)
    radius, inner, size = (np.array([c[n] for c in cells], float) for n in ("radius", "inner", "n"))
    between = np.sqrt(_squares(pivots, pivots))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far, own, found = _matrix(batch.column("far")), np.asarray(batch.column("cell")), np.asarray(batch.column("found"))
            every = np.arange(len(far))
            d, home = far[:, number], far[every, own][:, None]
            order = np.argsort(d + radius, axis=1)
            enough = (size[order].cumsum(1) < k).sum(1)  # cells that don't hold k points yet
            sure = np.c_[np.take_along_axis(d + radius, order, 1), np.full(len(d), np.inf)][every, enough]
            reach = (np.minimum(sure, found) * (1 + 1e-9) + 1e-12 * (1 + d.max(1)))[:, None]  # rounding
            apart = between[:, number][own]
            beyond = (apart > 0) & (d * d - home * home > 2 * np.where(apart > 0, apart, 1) * reach + 1e-12 * (d * d + home * home))
            hit = np.isfinite(d) & (d - radius <= reach) & (inner - d <= reach) & ~beyond
            ends = pa.array(np.r_[0, hit.sum(1).cumsum()].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.broadcast_to(number, hit.shape)[hit], d[hit])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("q"), batch.column("cell"), pa.array(reach[:, 0]), *lists], ["row", "q", "own", "reach", "cells", "dists"])

    kind = queries.schema["row"].dataType.simpleString()
    return queries.select("row", "q", "far", "cell", "found").mapInArrow(run, f"row {kind}, q array<double>, own int, reach double, cells array<int>, dists array<double>")


def _pairs(reached: DataFrame) -> DataFrame:
    """``row, q, own, reach, cell, dist``: a row for each query and cell."""
    each = reached.select("row", "q", "own", "reach", F.explode(F.arrays_zip("cells", "dists")).alias("at"))
    return each.select("row", "q", "own", "reach", F.col("at.cells").alias("cell"), F.col("at.dists").alias("dist"))


def _nearest(pairs: DataFrame, points: DataFrame, cells: list, block: int, k: int, leave_own: bool) -> DataFrame:
    """``row, r, y, d, tested``: of each pair's block the k nearest points; a row without ``r`` says how many distances were taken.

    A cell's points and the queries that reach it are dealt in blocks of bounded
    size, and a block of each meet in a task.
    """
    several = {r["cell"]: -(-r["n"] // block) for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    table = [(c["cell"], -(-c["n"] // block), several[c["cell"]]) for c in cells if c["cell"] in several]
    blocks = pairs.sparkSession.createDataFrame(table, "cell int, nb long, nq long")
    spread = lambda c, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    asked = pairs.join(F.broadcast(blocks), "cell").withColumn("qb", deal("row", "nq")).select("row", "q", "cell", "dist", "reach", "qb", spread("pb", "nb"))
    held = points.join(F.broadcast(blocks), "cell").withColumn("pb", deal("r", "nb")).select("r", "y", "x", "cell", F.get("far", F.col("cell")).alias("dist"), "pb", spread("qb", "nq"))

    def run(queries: pa.Table, near: pa.Table) -> pa.Table:
        i, j, d, tested = np.empty(0, int), np.empty(0, int), np.empty(0), 0
        if queries.num_rows and near.num_rows:
            rows, q, at, reach = queries["row"].to_numpy(), _matrix(queries["q"]), queries["dist"].to_numpy(), queries["reach"].to_numpy()
            ids, x, dist = near["r"].to_numpy(), _matrix(near["x"]), near["dist"].to_numpy()
            use = first_copies(x, ids, k + int(leave_own))  # more copies of a vector are nobody's k nearest
            use = use[np.argsort(dist[use], kind="stable")]
            i, j, d, tested = closest(q, at, reach, x[use], dist[use], ids[use], k, rows if leave_own else None)
            j = use[j]
        found = pa.table({"row": queries["row"].take(pa.array(i)), "r": near["r"].take(pa.array(j)), "y": near["y"].take(pa.array(j)), "d": d, "tested": np.zeros(len(d), np.int64)})
        count = pa.table({n: pa.array([tested if n == "tested" else None], found.schema.field(n).type) for n in found.column_names})
        return pa.concat_tables([found, count])

    kinds = [*(f"{n} {of.schema[n].dataType.simpleString()}" for n, of in (("row", pairs), ("r", points), ("y", points))), "d double, tested long"]
    return asked.groupBy("cell", "pb", "qb").cogroup(held.groupBy("cell", "pb", "qb")).applyInArrow(run, ", ".join(kinds))


def neighbours(points: DataFrame, queries: DataFrame, k: int, leave_own: bool = False, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The k nearest ``points(r, y, x)`` of each of ``queries(row, q)``, exactly: ``row, r, y, d`` (squared), and the rows that count distances.

    Points belong to the nearest of ``pivots`` points drawn by hash.  A query
    first meets the cell of its own pivot, which bounds its k-th distance, and
    then the other cells that the triangle inequality leaves; in a cell, only
    points whose distance to the pivot differs by no more than the bound.  Equal
    distances go by ``r``.  Vectors that are not finite are nobody's neighbours.
    """
    more = k + int(leave_own)
    points = points.where(F.forall("x", lambda v: F.abs(v) < float("inf")))
    drawn = points.select("x", F.xxhash64("r").alias("h"), "r").orderBy("h", "r").limit(pivots).collect()
    if not drawn:
        none = queries.join(points, F.lit(False)).select("row", "r", "y", F.lit(0.0).alias("d"))
        return none, none.withColumn("tested", F.lit(0))
    base = np.array([d["x"] for d in drawn], float)
    indexed = keep(_by_cell(points, "x", base), "points")
    to_own = F.get("far", F.col("cell"))
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max(to_own).alias("radius"), F.min(to_own).alias("inner")).collect()  # a row a pivot
    asked = keep(_by_cell(queries, "q", base), "queries")
    block = max(1, min(BLOCK, WIDE // base.shape[1]))
    own = keep(_pairs(_reachable(asked.withColumn("found", F.lit(float("inf"))), cells, base, more)).where("cell = own"), "pairs")
    first = keep(_nearest(own, indexed, cells, block, k, leave_own), "first")
    bound = first.where("row IS NOT NULL").groupBy("row").agg(F.sqrt(F.get(F.sort_array(F.collect_list("d")), F.lit(k - 1))).alias("found"))
    asked = asked.join(bound, "row", "left").withColumn("found", F.coalesce("found", F.lit(float("inf"))))
    others = _pairs(keep(_reachable(asked, cells, base, more), "reached")).where("cell != own")
    tried = first.unionByName(keep(_nearest(others, indexed, cells, block, k, leave_own), "others"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("d", "r"))
    return tried.where("row IS NOT NULL").select("row", "r", "y", "d", place.alias("place")).where(F.col("place") <= k).drop("place"), tried.where("row IS NULL")


def knn_classify(train: DataFrame, test: DataFrame, features: list[str], label: str, row: str, k: int = 7, leave_own: bool = False) -> DataFrame:
    """Class of each test row by its k nearest training rows: ``row, predicted``.

    Neighbours are exact (``neighbours``); with ``leave_own`` a row is none of its
    own.  Ids are unique.  Equal distances go by the id, equal votes by the
    smaller class.
    """
    vector = F.array(*features).cast("array<double>")
    points = train.select(F.col(row).alias("r"), F.col(label).alias("y"), vector.alias("x"))
    near, _ = neighbours(points, test.select(F.col(row).alias("row"), vector.alias("q")), k, leave_own)
    votes = near.groupBy("row", "y").agg(F.count("*").alias("votes"))
    return votes.groupBy("row").agg(F.max_by("y", F.struct("votes", -F.col("y"))).alias("predicted"))


def split_by_hash(rows: DataFrame, key: Column, share: float = 0.5) -> DataFrame:
    """Adds ``is_train``: a fixed pseudo-random share of the rows."""
    return rows.withColumn("is_train", F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(1000)) < int(share * 1000))


def split_by_time(rows: DataFrame, share: float = 0.8, key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``is_train``: the first share of each code's rows."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("is_train", F.row_number().over(_order(key, ts)) <= (n * F.lit(share)).cast("int"))


def align_series(bars: DataFrame, series: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Bars beside the close of every named series on the same date; dates with a gap go.

    A series is a row per date; Spark broadcasts those that are small.
    """
    for name, s in series.items():
        bars = bars.join(s.select(ts, F.col("close").alias(name)).where(F.col("close").isNotNull()), ts)
    return bars.dropna()


def pct_change(bars: DataFrame, column: str = "close", key: str = "code", ts: str = "ts") -> DataFrame:
    """Adds ``rate``: the relative change, 0 in the first row."""
    return bars.withColumn("rate", F.coalesce(F.col(column) / F.lag(column).over(_order(key, ts)) - 1, F.lit(0.0)))


def cut_classes(rows: DataFrame, column: str = "rate", edges=(-10.0, -0.01, 0.0, 0.01, 10.0)) -> DataFrame:
    """Adds ``y``: number of the right-closed interval, null outside."""
    y = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        y = F.when((F.col(column) > edges[k]) & (F.col(column) <= edges[k + 1]), k).otherwise(y)
    return rows.withColumn("y", y)


def log_diff(bars: DataFrame, columns: list[str], key: str = "code", ts: str = "ts") -> DataFrame:
    """First differences of log10 of the columns; the first row of each code goes."""
    order = _order(key, ts)
    rows = bars.withColumn("_rn", F.row_number().over(order))
    rows = rows.withColumns({c: F.log10(c) - F.log10(F.lag(c).over(order)) for c in columns})
    return rows.where("_rn > 1").drop("_rn")


def class_counts(rows: DataFrame, key: str = "code") -> DataFrame:
    return rows.groupBy(key, "y").agg(F.count("*").alias("n"))


def sequences(rows: DataFrame, columns: list[str], n: int = 40, key: str = "code", ts: str = "ts") -> DataFrame:
    """``code, ts, y, steps``: the n rows before each row, oldest first, as an array of structs."""
    before = _order(key, ts).rowsBetween(-n, -1)
    rows = rows.withColumn("steps", F.collect_list(F.struct(*columns)).over(before))
    return rows.where(F.size("steps") == n).select(key, ts, "y", "steps")


def confusion(rows: DataFrame, classes: int = 4, true: str = "y", predicted: str = "p") -> DataFrame:
    """A row per true class, a column ``p_<k>`` per predicted one."""
    return rows.groupBy(true).agg(*[F.count_if(F.col(predicted) == k).alias(f"p_{k}") for k in range(classes)])


def precision_recall(rows: DataFrame, positives=(2, 3), true: str = "y", predicted: str = "p", key: str | None = None, eps: float = 1e-7) -> DataFrame:
    """Precision, recall and F of the positive classes."""
    t, p = F.col(true).isin(*positives), F.col(predicted).isin(*positives)
    grouped = rows.groupBy(key) if key else rows.groupBy()
    counts = grouped.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    counts = counts.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + eps), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + eps)})
    return counts.withColumn("f", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def selection_gate(scores: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Codes with F > 0.65, precision > 0.60 and a predicted class of 2 or 3."""
    best = F.array_position(probabilities, F.array_max(probabilities)) - 1
    return scores.where((F.col("f") > 0.65) & (F.col("precision") > 0.60) & best.isin(2, 3))


def sequence_classifier(sequences_: DataFrame, columns: list[str], n: int, classes: int = 4, seed: int = 1, iterations: int = 20):
    """A pooled classifier of flattened sequences; ``transform`` the result of :func:`flatten`."""
    model = MultilayerPerceptronClassifier(layers=[n * len(columns), 16, classes], seed=seed, maxIter=iterations, labelCol="label")
    return model.fit(flatten(sequences_, columns))


def flatten(sequences_: DataFrame, columns: list[str], scale: float = 1.0) -> DataFrame:
    steps = F.flatten(F.transform("steps", lambda s: F.array(*[(s[c] * scale).cast("double") for c in columns])))
    return sequences_.where("y IS NOT NULL").select("*", array_to_vector(steps).alias("features"), F.col("y").cast("double").alias("label"))
