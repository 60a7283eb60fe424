"""Queries that fit models; their rows have no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep
from ..operators import models as M
from ..operators import validation as V
from ..operators.indicators import cut_classes, flatten, pct_change, sequence_classifier, sequences, split_by_time
from ..sources.adapters import bars, table
from .common import rounded

NAMES = [f"x{k}" for k in range(64)]  # all columns of an embedding
TREES, DEPTH, FOLDS = 5, 3, 2


def _observations(spark, d):
    """Vectors as observations in order of vec_id, each of three steps' length; the label: below the middle class or not.

    Written, so that Spark doesn't derive filters through 64 expressions of one array.
    """
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row"),
        F.col("vec_id").alias("t0"),
        (F.col("vec_id") + 2).alias("t1"),
        (F.col("label") < 5).cast("double").alias("label"),
        F.lit(1.0).alias("w"),
        *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(NAMES)],
    )
    return keep(rows, "observations")


def _rows(spark, d):
    return keep(V.purged_kfold(_observations(spark, d), FOLDS, 0.01, ["t0"]), "folds")


def _forest(**more):
    return M.forest(TREES, DEPTH, **more)


def _held_out(spark, d, forest):
    """Every vector classified by the forest of the other folds."""
    return M.out_of_fold(lambda train: forest.fit(M.balanced(train)), M.assemble(_rows(spark, d), NAMES), FOLDS).select("row", "prediction")


def _whole(spark, d):
    return M.balanced(M.assemble(_observations(spark, d), NAMES))


def c5_cv(spark, d):
    scores = V.cv_score(_forest(), M.assemble(_rows(spark, d), NAMES), FOLDS)
    return spark.createDataFrame(list(enumerate(scores)), "fold long, score double")


def e1_forest(spark, d):
    return _held_out(spark, d, _forest(weight="bw"))


def e3_mdi(spark, d):
    rows = _whole(spark, d)
    return M.mdi(_forest().fit(rows), NAMES, rows)


def e4_mda(spark, d):
    return M.mda(_forest(), _rows(spark, d), NAMES, FOLDS)


def e5_sfi(spark, d):
    return M.sfi(_forest(), _rows(spark, d), NAMES, FOLDS)


def e2_bagged_features(spark, d):
    """Bagged trees that see one feature at a split."""
    return _held_out(spark, d, _forest(weight="bw", features="1"))


def e2_bagged_trees(spark, d):
    """Bagged trees that see every feature, each on half of the rows."""
    return _held_out(spark, d, _forest(weight="bw", features="all", share=0.5))


def e6_driver(spark, d):
    """The three importances side by side, through the one entry point."""
    rows, folds = _observations(spark, d), _rows(spark, d)
    parts = [M.feature_importance(m, _forest(), rows, folds, NAMES, FOLDS).withColumn("method", F.lit(m)) for m in ("MDI", "MDA", "SFI")]
    return reduce(DataFrame.unionByName, parts).select("method", "feature", "mean", "std", "oos")


def e8_random_search(spark, d):
    """Log-uniform settings, scored on purged folds; the best one, bagged on all rows, predicts every row."""
    grid = M.random_grid({"trees": (2, 6), "depth": (2, 4)}, 2)
    best, _ = M.purged_grid_search(M.forest, grid, M.assemble(_rows(spark, d), NAMES), FOLDS)
    whole = M.assemble(_observations(spark, d), NAMES)
    return rounded(M.bagged_predict(M.bagged_fit(M.forest, best, whole, bags=2), whole), "probability")


def e7_search(spark, d):
    grid = [{"trees": t, "depth": 3} for t in (3, 6)]
    return M.purged_grid_search(M.forest, grid, M.assemble(_rows(spark, d), NAMES), FOLDS)[1]


def n4_gbt(spark, d):
    """Every vector's value from the trees boosted on the other folds."""
    fit = lambda train: M.boosted_regression(train.drop("features"), NAMES, "label", rounds=5, depth=3, step=0.1, share="0.5")
    return rounded(M.out_of_fold(fit, M.assemble(_rows(spark, d), NAMES), FOLDS).select("row", "prediction"), "prediction")


def d9_sequence_clf(spark, d):
    """A pooled classifier of ten-day windows, fitted to the first 80 % of each code and asked about the rest."""
    windows = keep(split_by_time(sequences(cut_classes(pct_change(bars(spark, d))), ["rate"], 10)), "windows")
    model = sequence_classifier(windows.where("is_train"), ["rate"], 10, iterations=5)
    return model.transform(flatten(windows.where("NOT is_train"), ["rate"])).groupBy("prediction").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (c5_cv, e1_forest, e2_bagged_features, e2_bagged_trees, e3_mdi, e4_mda, e5_sfi, e6_driver, e7_search, e8_random_search, n4_gbt, d9_sequence_clf)}
SQL: dict[str, str] = {}
