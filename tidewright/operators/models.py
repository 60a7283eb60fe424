"""Tree ensembles, feature importance and parameter search on ``pyspark.ml``."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from statistics import mean, pstdev, stdev

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import POSITION, cv_score, positions


def assemble(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(rows)


def balanced(rows: DataFrame, label: str = "label", weight: str = "w") -> DataFrame:
    """Adds ``bw``: weights scaled so that every class sums alike."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    counts = counts.join(F.broadcast(total))  # one row
    return rows.join(F.broadcast(counts), label).withColumn("bw", F.col(weight) * F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def forest(trees: int = 100, depth: int = 5, weight: str | None = None, share: float = 1.0, features: str = "auto", seed: int = 1, label: str = "label"):
    """Entropy forest; ``features='1'`` gives bagged single-feature trees, ``'all'`` bagged trees."""
    more = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(
        impurity="entropy", numTrees=trees, maxDepth=depth, subsamplingRate=share, featureSubsetStrategy=features, seed=seed, labelCol=label, **more
    )


def mdi(model, names: list[str], rows: DataFrame) -> DataFrame:
    """``feature, mean, std``: mean decrease of impurity over trees, zeros as missing, scaled to sum to 1."""
    values = {n: [float(t.featureImportances[k]) for t in model.trees] for k, n in enumerate(names)}
    found = {n: [v for v in vs if v > 0] for n, vs in values.items()}
    means = {n: mean(vs) if vs else 0.0 for n, vs in found.items()}
    total = sum(means.values()) or 1.0
    errors = {n: stdev(vs) / math.sqrt(len(vs)) if len(vs) > 1 else 0.0 for n, vs in found.items()}
    return rows.sparkSession.createDataFrame([(n, means[n] / total, errors[n] / total) for n in names], "feature string, mean double, std double")


def _score(scoring: str) -> Column:
    """Of a transformed row: right or not, or the logarithm of its label's probability."""
    if scoring == "logLoss":
        return F.log(F.greatest(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(1e-15)))
    return (F.col("prediction") == F.col("label")).cast("double")


def _partners(rows: DataFrame, names: list[str], seed: int, row: str = "row") -> DataFrame:
    """``label, _own, _other``: every row once, with its own values and those of its partner.

    A row's partner is the one at its place in an order shuffled by ``seed``;
    both orders are numbered by ranges, so no task sees all rows.
    """
    values = rows.select(F.col(row).alias("_row"), "label", F.array(*[F.col(n).cast("double") for n in names]).alias("_own"))
    numbered = positions(values, ["_row"])
    other = values.select(F.xxhash64(F.lit(seed), "_row").alias("_shuffled"), "_row", F.col("_own").alias("_other"))
    other = positions(other, ["_shuffled", "_row"]).select("_other", F.col(POSITION).alias("_at"))
    return numbered.join(other, F.col(POSITION) == F.col("_at")).select("label", "_own", "_other")


def permuted(rows: DataFrame, names: list[str], seed: int, row: str = "row") -> DataFrame:
    """``feature, label, features``: every row once for each feature, with that feature's value from its partner."""
    each = _partners(rows, names, seed, row).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("feature"))
    mixed = F.transform("_own", lambda x, k: F.when(k == F.col("feature"), F.get("_other", k)).otherwise(x))
    return each.select("feature", "label", array_to_vector(mixed).alias("features"))


def tree_arrays(model) -> list[dict[str, np.ndarray]] | None:
    """The nodes of a fitted forest of classification trees as arrays; None for any other model, or with categories.

    As many numbers as the model has nodes, whatever it was fitted to.
    """
    if not isinstance(model, RandomForestClassificationModel):
        return None
    out = []
    for tree in model.trees:
        nodes, waiting = [], [(tree._call_java("rootNode"), 0)]
        nodes.append(None)
        while waiting:
            node, at = waiting.pop()
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, at, at, list(node.impurityStats().stats()))
                continue
            split = node.split()
            if "Continuous" not in split.getClass().getSimpleName():
                return None
            left, right = len(nodes), len(nodes) + 1
            nodes += [None, None]
            nodes[at] = (split.featureIndex(), split.threshold(), left, right, [0.0] * model.numClasses)
            waiting += [(node.leftChild(), left), (node.rightChild(), right)]
        kinds = zip(("feature", "threshold", "left", "right", "votes"), (np.int64, float, np.int64, np.int64, float))
        out.append({name: np.array(column, kind) for (name, kind), column in zip(kinds, zip(*nodes))})
    return out


def _votes(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class shares of the leaves that the rows of ``x`` reach."""
    at = np.zeros(len(x), np.int64)
    while True:
        feature = tree["feature"][at]
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            break
        low = x[inner, feature[inner]] <= tree["threshold"][at[inner]]
        at[inner] = np.where(low, tree["left"][at[inner]], tree["right"][at[inner]])
    found = tree["votes"][at]
    return found / np.maximum(found.sum(1, keepdims=True), 1e-300)


def _row_scores(votes: np.ndarray, label: np.ndarray, scoring: str) -> np.ndarray:
    if scoring == "logLoss":
        return np.log(np.maximum(votes[np.arange(len(label)), label] / votes.sum(1), 1e-15))
    return (votes.argmax(1) == label).astype(float)


def _swapped_scores(trees: list[dict[str, np.ndarray]], partners: DataFrame, n: int, scoring: str) -> DataFrame:
    """``feature, score``: a task holds the forest and swaps one column at a time inside its batches.

    A column changes the votes of the trees that use it and of no others.  One
    row a feature leaves a task.
    """
    uses = [set(t["feature"][t["feature"] >= 0].tolist()) for t in trees]

    def run(batches):
        total, rows = np.zeros(n), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                own, other = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("_own", "_other"))
                label = part.column("label").to_numpy(zero_copy_only=False).astype(int)
                votes = [_votes(t, own) for t in trees]
                whole = sum(votes)
                for f in range(n):
                    touched = [i for i, used in enumerate(uses) if f in used]
                    x = own
                    if touched:
                        x = own.copy()
                        x[:, f] = other[:, f]
                    total[f] += _row_scores(whole + sum((_votes(trees[i], x) - votes[i] for i in touched), np.zeros_like(whole)), label, scoring).sum()
                rows += len(label)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total), pa.array([rows] * n, pa.int64())], ["feature", "s", "n"])

    sums = partners.mapInArrow(run, "feature int, s double, n long").groupBy("feature")
    return sums.agg((F.sum("s") / F.sum("n")).alias("score"))


def mda(estimator, folds: DataFrame, names: list[str], k: int, seed: int = 1, scoring: str = "accuracy") -> DataFrame:
    """``feature, mean, std``: relative loss of the score when a test column is shuffled.

    A row crosses the shuffle with its partner's values once; a forest is scored
    inside the batches, any other model on a row for each column.
    """
    drops: dict[str, list[float]] = {n: [] for n in names}
    for f in range(k):
        part = folds.where(F.col("fold") == f)
        model = estimator.fit(assemble(part.where("role = 'train'"), names))
        test = part.where("role = 'test'")
        s0 = model.transform(assemble(test, names)).agg(F.avg(_score(scoring))).first()[0]
        trees = tree_arrays(model)
        if trees is None:
            found = model.transform(permuted(test, names, seed + f)).groupBy("feature").agg(F.avg(_score(scoring)).alias("score"))
        else:
            found = _swapped_scores(trees, _partners(test, names, seed + f), len(names), scoring)
        for r in found.collect():  # a row a feature
            base = -r["score"] if scoring == "logLoss" else 1 - r["score"]
            drops[names[r["feature"]]].append((s0 - r["score"]) / base if base else 0.0)
    rows = [(n, mean(v) if v else 0.0, stdev(v) / math.sqrt(len(v)) if len(v) > 1 else 0.0) for n, v in drops.items()]
    return folds.sparkSession.createDataFrame(rows, "feature string, mean double, std double")


def grow_on_bins(counts: np.ndarray, depth: int) -> np.ndarray:
    """Class shares of each bin under an entropy tree on one ordered feature, from its ``counts[bin, class]``.

    A level splits every stretch of bins where the entropy falls most (of equal
    cuts, at the lowest); a stretch that no cut improves stays a leaf.
    """
    size = lambda c: c.sum(-1)
    entropy = lambda c: -np.where(c > 0, c * np.log2(np.where(c > 0, c, 1) / np.maximum(size(c)[..., None], 1e-300)), 0).sum(-1)
    stretches = [(0, len(counts))]
    for _ in range(depth):
        parts = []
        for a, b in stretches:
            left = counts[a : b - 1].cumsum(0)
            right = counts[a:b].sum(0) - left
            gain = np.where((size(left) > 0) & (size(right) > 0), entropy(counts[a:b].sum(0)) - entropy(left) - entropy(right), 0)
            cut = int(gain.argmax()) + a + 1 if len(gain) and gain.max() > 1e-12 else b
            parts += [(a, b)] if cut == b else [(a, cut), (cut, b)]
        if parts == stretches:
            break
        stretches = parts
    out = np.empty(counts.shape)
    for a, b in stretches:
        total = counts[a:b].sum(0)
        out[a:b] = total / total.sum() if total.sum() else 1 / counts.shape[1]
    return out


def fold_histograms(folds: DataFrame, names: list[str], k: int, classes: int, bins: int) -> np.ndarray:
    """Rows by (feature, fold, train or test, bin, class), bins between quantiles of each feature, in one pass over the rows.

    A task adds up its rows; the sums have one size however many rows there are.
    """
    cuts = [np.unique(c) for c in folds.approxQuantile(names, np.linspace(0, 1, bins + 1)[1:-1].tolist(), 1 / (8 * bins))]
    shape = (len(names), k, 2, bins, classes)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            fold, label = (batch.column(c).to_numpy(zero_copy_only=False).astype(int) for c in ("fold", "label"))
            test = batch.column("test").to_numpy(zero_copy_only=False).astype(int)
            for f, name in enumerate(names):
                bin_of = np.searchsorted(cuts[f], batch.column(name).to_numpy(zero_copy_only=False).astype(float), "left")
                at = np.ravel_multi_index((fold, test, bin_of, label), shape[1:])
                total[f] += np.bincount(at, minlength=total[f].size).reshape(shape[1:])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used])], ["at", "n"])

    rows = folds.select("fold", "label", (F.col("role") == "test").alias("test"), *names).dropna()
    out = np.zeros(shape)
    for row in rows.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out.ravel()[row["at"]] = row["n"]
    return out


def sfi(estimator, folds: DataFrame, names: list[str], k: int, scoring: str = "accuracy", bins: int = 32) -> DataFrame:
    """``feature, mean, std``: the purged score of each feature alone.

    For entropy forests one histogram serves all: a tree on one feature only cuts
    its bins, so every feature's and fold's tree is grown, and scored on the test
    rows, from counts.  It is the one tree on all training rows that the forest's
    trees vary about.  Other estimators are fitted for each feature and fold.
    """
    if isinstance(estimator, RandomForestClassifier) and estimator.getImpurity() == "entropy":
        classes = int(folds.agg(F.max("label")).first()[0] or 0) + 1
        counts = fold_histograms(folds, names, k, classes, bins)
        rows = []
        for name, of in zip(names, counts):
            scores = []
            for train, test in of:
                share = grow_on_bins(train, estimator.getMaxDepth())
                n = max(test.sum(), 1.0)
                if scoring == "logLoss":
                    scores.append(float((test * np.log(np.maximum(share, 1e-15))).sum() / n))
                else:
                    scores.append(float(test[np.arange(bins), share.argmax(1)].sum() / n))
            rows.append((name, mean(scores), pstdev(scores) / math.sqrt(k)))
    else:
        rows = []
        for name in names:
            s = cv_score(estimator.copy(), assemble(folds, [name]), k, scoring)
            rows.append((name, mean(s), pstdev(s) / math.sqrt(k)))
    return folds.sparkSession.createDataFrame(rows, "feature string, mean double, std double")


def feature_importance(method: str, estimator, rows: DataFrame, folds: DataFrame, names: list[str], k: int, seed: int = 1) -> DataFrame:
    """MDI, MDA or SFI, with the out-of-sample score ``oos`` of all features; ``rows`` are the observations, ``folds`` their purged folds."""
    oos = mean(cv_score(estimator, assemble(folds, names), k, "accuracy"))
    if method == "MDI":
        found = mdi(estimator.fit(assemble(rows, names)), names, folds)
    elif method == "MDA":
        found = mda(estimator, folds, names, k, seed)
    else:
        found = sfi(estimator, folds, names, k)
    return found.withColumn("oos", F.lit(oos))


def out_of_fold(fit, folds: DataFrame, k: int) -> DataFrame:
    """The rows of all test folds with what a model of their fold's training rows says of them; ``fit(train)`` gives the model."""
    parts = [folds.where(F.col("fold") == f) for f in range(k)]
    return reduce(DataFrame.unionByName, [fit(p.where("role = 'train'")).transform(p.where("role = 'test'")) for p in parts])


def log_uniform(a: float, b: float, n: int, seed: int = 1) -> list[float]:
    """Draws whose logarithm is uniform between those of a and b."""
    rng = random.Random(seed)
    return [a * (b / a) ** rng.random() for _ in range(n)]


def random_grid(space: dict[str, tuple[float, float]], n: int, seed: int = 1) -> list[dict]:
    """``n`` settings whose parameters are log-uniform in their intervals; intervals of whole numbers give whole numbers."""
    drawn = {name: log_uniform(a, b, n, seed + k) for k, (name, (a, b)) in enumerate(space.items())}
    whole = {name for name, bounds in space.items() if all(isinstance(x, int) for x in bounds)}
    return [{name: round(drawn[name][i]) if name in whole else drawn[name][i] for name in space} for i in range(n)]


def purged_grid_search(build, grid: list[dict], folds: DataFrame, k: int, scoring: str | None = None, threads: int = 2) -> tuple[dict, DataFrame]:
    """Best parameters by the mean purged score, and all scores; fits run side by side.

    ``build(**params)`` gives an estimator of ``features`` and ``label``.  With
    labels 0 and 1 the score is F1 of class 1, else minus log loss.
    """
    if scoring is None:
        labels = {r[0] for r in folds.select("label").distinct().limit(3).collect()}
        scoring = "fMeasureByLabel" if labels <= {0.0, 1.0} else "logLoss"

    def one(params: dict) -> float:
        if scoring == "fMeasureByLabel":
            evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName=scoring, metricLabel=1.0)
            scores = []
            for f in range(k):
                part = folds.where(F.col("fold") == f)
                scores.append(evaluator.evaluate(build(**params).fit(part.where("role = 'train'")).transform(part.where("role = 'test'"))))
            return mean(scores)
        return mean(cv_score(build(**params), folds, k, scoring))

    folds = folds.cache()
    with ThreadPoolExecutor(threads) as pool:
        scores = list(pool.map(one, grid))
    folds.unpersist()
    best = max(range(len(grid)), key=scores.__getitem__)
    table = folds.sparkSession.createDataFrame([(str(p), float(s)) for p, s in zip(grid, scores)], "params string, score double")
    return grid[best], table


def bagged_fit(build, params: dict, rows: DataFrame, bags: int = 0, share: float = 1.0, seed: int = 1) -> list:
    """The chosen setting fitted to all rows: one model, or ``bags`` of them on draws with replacement of ``share`` of the rows."""
    if not bags:
        return [build(**params).fit(rows)]
    return [build(**params).fit(rows.sample(True, share, seed + b)) for b in range(bags)]


def bagged_predict(models: list, rows: DataFrame, row: str = "row") -> DataFrame:
    """``row, prediction, probability``: the class with the largest mean probability over the models."""
    parts = [m.transform(rows).select(row, vector_to_array("probability").alias("p")) for m in models]
    each = reduce(DataFrame.unionByName, parts).select(row, F.posexplode("p").alias("class", "p"))
    means = each.groupBy(row, "class").agg(F.avg("p").alias("p"))
    best = F.max_by(F.struct("class", "p"), F.struct("p", -F.col("class"))).alias("best")
    return means.groupBy(row).agg(best).select(row, F.col("best.class").cast("double").alias("prediction"), F.col("best.p").alias("probability"))


def boosted_regression(rows: DataFrame, names: list[str], target: str, rounds: int = 2000, depth: int = 5, step: float = 0.01, share: str = "0.1", seed: int = 1):
    """Gradient-boosted trees on the named features."""
    model = GBTRegressor(maxDepth=depth, stepSize=step, maxIter=rounds, featureSubsetStrategy=share, labelCol=target, seed=seed)
    return model.fit(assemble(rows, names))
