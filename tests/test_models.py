"""Model operators on planted data: the first feature decides the label, the others are noise."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import indicators as I
from tidewright.operators import models as M
from tidewright.operators import validation as V

NAMES = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000
    table = spark.range(240).select(
        F.col("id").alias("row"), F.col("id").alias("t0"), (F.col("id") + 2).alias("t1"), F.lit(1.0).alias("w"), *[noise(k).alias(n) for k, n in enumerate(NAMES)]
    )
    return table.withColumn("label", (F.col("x0") > 0.5).cast("double")).cache()


@pytest.fixture(scope="module")
def folds(rows):
    return V.purged_kfold(rows, 2, 0.01, ["t0"]).cache()


def test_folds_by_hand(folds):
    """Two halves; a train row overlaps no test row and keeps the embargo of int(240 * 0.01) = 2 positions."""
    role = collections.defaultdict(set)
    for r in folds.select("fold", "role", "row").collect():
        role[r.fold, r.role].add(r.row)
    assert role[0, "test"] == set(range(120)) and role[1, "test"] == set(range(120, 240))
    assert role[0, "train"] == set(range(123, 240))  # the last test ends at 121: from position 121 + 2
    assert role[1, "train"] == set(range(119))  # t1 = row + 2 at most 120


def test_importances_find_the_planted_feature(rows, folds):
    forest = M.forest(8, 3)
    found = {r.feature: r.mean for r in M.mdi(forest.fit(M.assemble(rows, NAMES)), NAMES, rows).collect()}
    assert sum(found.values()) == pytest.approx(1) and found["x0"] > 0.6
    lost = {r.feature: r.mean for r in M.mda(forest, folds, NAMES, 2).collect()}
    assert lost["x0"] > 0.5 and all(abs(lost[n]) < lost["x0"] / 2 for n in NAMES[1:])
    logs = {r.feature: r.mean for r in M.mda(forest, folds, NAMES, 2, scoring="logLoss").collect()}
    assert logs["x0"] > max(logs["x1"], logs["x2"])
    alone = {r.feature: r.mean for r in M.sfi(M.forest(3, 2), folds, NAMES, 2).collect()}
    assert alone["x0"] > 0.95 > 0.7 > max(alone["x1"], alone["x2"])
    driven = M.feature_importance("MDI", forest, rows, folds, NAMES, 2).collect()
    assert {r.feature for r in driven} == set(NAMES) and driven[0].oos > 0.9


def test_a_shuffled_column_keeps_the_others(rows):
    mixed = M.permuted(rows, NAMES, 5).collect()
    plain = [tuple(r[n] for n in NAMES) for r in rows.collect()]
    assert len(mixed) == 3 * 240
    for k in range(3):
        got = [tuple(r.features.toArray()) for r in mixed if r.feature == k]
        assert sorted(x[k] for x in got) == pytest.approx(sorted(x[k] for x in plain))
        rest = lambda x: tuple(round(v, 6) for j, v in enumerate(x) if j != k)
        assert sorted(map(rest, got)) == sorted(map(rest, plain)) and got != plain


def test_weights_of_classes(rows):
    sums = {r.label: r.s for r in M.balanced(rows).groupBy("label").agg(F.sum("bw").alias("s")).collect()}
    assert sums[0.0] == pytest.approx(sums[1.0]) == pytest.approx(120)


def test_random_search_refits_and_bags(rows, folds):
    grid = M.random_grid({"trees": (2, 5), "share": (0.3, 1.0)}, 4)
    assert len(grid) == 4 and all(isinstance(g["trees"], int) and 2 <= g["trees"] <= 5 and 0.3 <= g["share"] <= 1 for g in grid)
    logs = [math.log(x) for x in M.log_uniform(1e-3, 1e3, 400)]
    assert abs(sum(logs) / 400) < 0.7 and -7 < min(logs) < -5 < 5 < max(logs) < 7
    ready = M.assemble(folds, NAMES)
    best, table = M.purged_grid_search(M.forest, [{"trees": 3, "depth": 0}, {"trees": 3, "depth": 3}], ready, 2)
    scores = [r.score for r in table.collect()]
    assert best == {"trees": 3, "depth": 3} and scores[1] > 0.9 > scores[0]
    whole = M.assemble(rows, NAMES)
    for bags in (0, 3):
        models = M.bagged_fit(M.forest, best, whole, bags, 0.8)
        got = M.bagged_predict(models, whole).join(rows.select("row", "label"), "row")
        assert len(models) == max(1, bags) and got.where("prediction = label").count() > 225 and got.count() == 240
        assert got.where("probability < 0.5 OR probability > 1.000001").isEmpty()


def test_boosting_and_scores(rows, folds):
    model = M.boosted_regression(rows, NAMES, "label", rounds=5, depth=2, step=0.5, share="1.0")
    error = model.transform(M.assemble(rows, NAMES)).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert error < 0.1
    accuracy = V.cv_score(M.forest(5, 3), M.assemble(folds, NAMES), 2, "accuracy")
    assert len(accuracy) == 2 and min(accuracy) > 0.9 and all(x < 0 for x in V.cv_score(M.forest(5, 3), M.assemble(folds, NAMES), 2))


def test_sequence_classifier_on_held_out_sequences(spark):
    """The class follows the sum of the last steps; a code of its own is held out."""
    draw = random.Random(7)
    rows = [(c, t, draw.uniform(-1, 1)) for c in range(4) for t in range(200)]
    table = spark.createDataFrame(rows, "code int, ts long, rate double")
    last = Window.partitionBy("code").orderBy("ts").rowsBetween(-4, -1)
    table = table.withColumn("y", F.when(F.sum("rate").over(last) > 0, 1).otherwise(0))
    steps = I.sequences(table, ["rate"], 4)
    model = I.sequence_classifier(steps.where("code < 3"), ["rate"], 4, classes=2, iterations=60)
    got = model.transform(I.flatten(steps.where("code = 3"), ["rate"])).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")), F.count("*")).first()
    assert got[0] > 0.9 and got[1] > 190


def test_neighbours_by_hand(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 2, 3]), float(draw.randint(0, 5)), float(draw.randint(0, 5))) for i in range(90)]
    rows += [(90, 1, 9.0, 9.0)]
    table = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = {r.row: r.predicted for r in I.knn_classify(table, table.where("id % 10 = 0"), ["a", "b"], "y", "id", 5, leave_own=True).collect()}
    for q in rows[::10]:
        near = sorted((x for x in rows if x[0] != q[0]), key=lambda x: ((x[2] - q[2]) ** 2 + (x[3] - q[3]) ** 2, x[0]))[:5]
        votes = collections.Counter(x[1] for x in near)
        assert got[q[0]] == min(votes, key=lambda y: (-votes[y], y))
    assert len(got) == 10


def test_hash_split_is_fixed(spark):
    got = {r.id: r.is_train for r in I.split_by_hash(spark.range(1000), F.col("id"), 0.3).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 1000 < 300 for i in range(1000)} and 250 < sum(got.values()) < 350
