"""Purged cross-validation over interval-labelled observations."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import keep

POSITION = "_pos"


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` in ranges of ``order``, numbered by ``_part`` and written, so that a rerun task sees the same ranges."""
    return keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def _earlier():
    """The ranges before: a window over a row per range."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def purge(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training intervals that overlap no test interval (both: t0, t1).

    An interval overlaps one of the tests that begin by its end if the largest
    end among those is at or after its own begin: a running maximum in order of
    time, in two levels (ranges, then rows in a range), instead of a join on
    inequalities.
    """
    columns = F.struct(*train.columns).alias("_row")
    rows = train.select(F.col("t1").alias("_t"), F.lit(None).cast(test.schema["t1"].dataType).alias("_b"), columns)
    begins = test.select(F.col("t0").alias("_t"), F.col("t1").alias("_b"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    both = _dealt(rows.unionByName(begins), ["_t"])
    sizes = both.groupBy("_part").agg(F.max("_b").alias("_m"))
    sizes = sizes.select("_part", F.max("_m").over(_earlier()).alias("_earlier"))
    inside = F.max("_b").over(Window.partitionBy("_part").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    held = both.withColumn("_b", inside).join(F.broadcast(sizes), "_part").where("_row IS NOT NULL")  # a row per range
    return held.where(~F.coalesce(F.greatest("_b", "_earlier") >= F.col("_row.t0"), F.lit(False))).select("_row.*")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds the global position in ``order`` from 0, in two levels: no task sees all rows.

    A range's rows are numbered in it, and the sums of the ranges before are added.
    """
    dealt = _dealt(rows, order)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_in", inside).join(F.broadcast(sizes), "_part")  # a row per range
    return numbered.withColumn(POSITION, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")


def kfold(rows: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Adds ``fold``, 0 to k - 1: contiguous blocks, the first n mod k one longer."""
    numbered = positions(rows, order)
    n = numbered.agg(F.count("*").alias("_n"))
    numbered = numbered.join(F.broadcast(n))  # one row
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    long = extra * (size + 1)
    fold = F.when(F.col(POSITION) < long, F.floor(F.col(POSITION) / (size + 1))).otherwise(
        extra + F.floor((F.col(POSITION) - long) / F.greatest(size, F.lit(1)))
    )
    return numbered.withColumn("fold", fold.cast("int")).drop("_n")


def embargo(times: DataFrame, pct: float, ts: str = "ts") -> DataFrame:
    """``ts, embargo``: the time int(n * pct) steps later; the last time at the end."""
    numbered = positions(times.select(ts), [ts])
    n = numbered.agg((F.count("*") * F.lit(pct)).cast("long").alias("step"), F.max(ts).alias("last"))
    rows = numbered.join(F.broadcast(n))  # one row
    later = numbered.select(F.col(POSITION).alias("p"), F.col(ts).alias("then"))
    return rows.join(later, F.col(POSITION) + F.col("step") == F.col("p"), "left").select(ts, F.coalesce("then", "last").alias("embargo"))


def purged_kfold(rows: DataFrame, k: int, pct: float, order: list[str]) -> DataFrame:
    """The rows of every fold: ``fold, role`` (train or test) beside each observation (t0, t1).

    Train: t1 before or at the test's start, or a position at least
    int(n * pct) after the first t0 at or after the test's last t1.
    """
    folds = keep(kfold(rows, k, order), "folds")
    tests = folds.groupBy("fold").agg(F.min("t0").alias("begin"), F.max("t1").alias("end"), F.min(POSITION).alias("low"), F.max(POSITION).alias("high"))
    tests = tests.orderBy("fold").collect()  # k rows
    # Positions are in order of t0: the first one at or after an end is the number of rows before it.
    earlier = [F.count_if(F.col("t0") < F.lit(t["end"])).alias(f"f{t['fold']}") for t in tests]
    counts = folds.agg(F.count("*").alias("n"), *earlier).first()
    plan = [(t["fold"], t["begin"], t["low"], t["high"], counts[f"f{t['fold']}"] + int(counts["n"] * pct)) for t in tests]
    kind = {f.name: f.dataType.simpleString() for f in folds.schema}
    plan = folds.sparkSession.createDataFrame(plan, f"fold int, begin {kind['t0']}, low long, high long, resume long")
    pairs = folds.drop("fold").join(F.broadcast(plan))  # k rows
    inside = F.col(POSITION).between(F.col("low"), F.col("high"))
    train = (F.col("t1") <= F.col("begin")) | (F.col(POSITION) >= F.col("resume"))
    role = F.when(inside, "test").when(train, "train")
    return pairs.withColumn("role", role).where("role IS NOT NULL").drop("begin", "low", "high", "resume", POSITION)


def cv_score(estimator, folds: DataFrame, k: int, scoring: str = "logLoss", label: str = "label", weight: str | None = None) -> list[float]:
    """Score of each purged fold: minus log loss, or accuracy."""
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName=scoring, **({"weightCol": weight} if weight else {}))
    scores = []
    for f in range(k):
        part = folds.where(F.col("fold") == f)
        model = estimator.fit(part.where("role = 'train'"))
        value = evaluator.evaluate(model.transform(part.where("role = 'test'")))
        scores.append(-value if scoring == "logLoss" else value)
    return scores


def label_histogram(bins: DataFrame, column: str = "bin", buckets: int = 10) -> DataFrame:
    """``bucket, n`` of equal-width buckets between the extremes, the last one closed."""
    ends = bins.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    rows = bins.join(F.broadcast(ends))  # one row
    bucket = F.least(F.floor(F.try_divide(F.col(column) - F.col("a"), F.col("b") - F.col("a")) * buckets), F.lit(buckets - 1))
    return rows.groupBy(F.coalesce(bucket, F.lit(0)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def describe(bins: DataFrame, column: str = "bin") -> DataFrame:
    """``count, mean, std, min, q25, q50, q75, max`` of a column: one row, counted per value before the shuffle."""
    p = lambda q: F.percentile(column, F.lit(q))
    values = [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min")]
    return bins.agg(*values, p(0.25).alias("q25"), p(0.5).alias("q50"), p(0.75).alias("q75"), F.max(column).alias("max"))
