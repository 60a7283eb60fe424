"""Hand-computed cases and plain-Python restatements of the market-data operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import numeric
from tidewright.operators import bars as B
from tidewright.operators import betting, fracdiff, labeling, reward, scoring, stats, strategy, validation, weights
from tidewright.sources import clean
from tidewright.streaming import refresh

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def closes(spark, values, code=1):
    return spark.createDataFrame([(code, day(k), float(v)) for k, v in enumerate(values)], "code long, ts date, close double")


def test_cusum(spark):
    rows = B.cusum_events(closes(spark, [100, 120, 140, 100, 60, 95]), 30.0).orderBy("t0").collect()
    assert [r.t0 for r in rows] == [day(2), day(3), day(4), day(5)]


def test_dollar_bars(spark):
    ticks = spark.createDataFrame([(1, k, k, 10.0, 1) for k in range(7)], "symbol long, ts long, seq long, price double, size long")
    rows = B.dollar_bars(ticks, 25.0).orderBy("bar_id").collect()
    assert [(r.bar_id, r.volume, r.dollars) for r in rows] == [(0, 3, 30.0), (1, 3, 30.0)]
    assert [r.volume for r in B.dollar_bars(ticks, 25.0, "cumulative").orderBy("bar_id").collect()] == [3, 2, 2]


def test_vwap_on_every_trade(spark):
    ticks = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 3), (2, 5.0, 0)], "symbol long, price double, size long")
    assert [(r.symbol, r.vwap) for r in B.with_vwap(ticks).orderBy("symbol", "price").collect()] == [(1, 17.5), (1, 17.5), (2, None)]


def test_concurrency_and_uniqueness(spark):
    bars = closes(spark, range(100, 106))
    events = spark.createDataFrame([(1, day(0), day(2)), (1, day(2), day(3)), (1, day(4), day(5))], "code long, t0 date, t1 date")
    assert [r.c for r in weights.concurrency(bars, events).orderBy("ts").collect()] == [1, 1, 2, 1, 1, 1]
    tw = [r.tw for r in weights.avg_uniqueness(bars, events).orderBy("t0").collect()]
    assert tw == pytest.approx([2.5 / 3, 0.75, 1.0])
    w = weights.normalise(weights.return_weights(bars, events)).collect()
    assert sum(r.w for r in w) == pytest.approx(3)


def test_sequential_bootstrap_is_more_unique_on_average(spark):
    rng = np.random.default_rng(0)
    first = rng.integers(0, 90, 10)
    last = first + rng.integers(1, 6, 10)
    mean = lambda draw: np.mean([numeric.mean_uniqueness(first, last, draw()) for _ in range(300)])
    assert mean(lambda: numeric.draw_sequential(first, last, 10, rng)) > mean(lambda: rng.integers(0, 10, 10))


def test_fracdiff(spark):
    assert fracdiff.weights(0.5, 5).tolist() == [1, -0.5, -0.125, -0.0625, -0.0390625]
    cut = fracdiff.weights_ffd(0.5, 1e-4)
    assert abs(cut[-1]) >= 1e-4 > abs(fracdiff.weights(0.5, len(cut) + 1)[-1]) and len(fracdiff.weights(0.3, 1)) == 1
    values = [float(random.Random(1).random() + k) for k in range(60)]
    w = fracdiff.weights_ffd(0.5, 1e-2)
    got = [r.fd_close for r in fracdiff.frac_diff_ffd(closes(spark, values), ["close"], 0.5, 1e-2).orderBy("ts").collect()]
    want = [sum(w[k] * values[i - k] for k in range(len(w))) for i in range(len(w) - 1, 60)]
    assert got == pytest.approx(want)


def test_ewm_deviation(spark):
    """Against the definition, term by term."""
    values = np.cumsum(np.random.default_rng(2).integers(-3, 4, 120)) + 100.0
    got = {r.ts: r.trgt for r in labeling.daily_vol(closes(spark, values), 1, span=20).collect()}
    ret, q = values[2:] / values[:-2] - 1, 1 - 2 / 21
    for n in (1, 5, 60, 117):
        w = q ** np.arange(n, -1, -1)
        mean = (w * ret[: n + 1]).sum() / w.sum()
        var = (w * (ret[: n + 1] - mean) ** 2).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())
        assert got[day(n + 2)] == pytest.approx(var**0.5)
    assert day(2) not in got


def plain_cusum(values, h):
    up = down = 0.0
    for i in range(1, len(values)):
        up, down = max(0.0, up + values[i] - values[i - 1]), min(0.0, down + values[i] - values[i - 1])
        if down < -h:
            down = 0.0
            yield i
        elif up > h:
            up = 0.0
            yield i


def test_sequential_helpers_against_one_step_at_a_time():
    rng = np.random.default_rng(4)
    for n, h in ((0, 3), (1, 3), (700, 1), (5000, 25), (3000, 10**6)):
        values = np.cumsum(rng.integers(-4, 5, n)).astype(float)
        assert np.flatnonzero(numeric.cusum_hits(values, h)).tolist() == list(plain_cusum(values, h))
        amounts, ids, total, k = rng.random(n) * 9, [], 0.0, 0
        for a in amounts:
            ids.append(k)
            total += a
            if total >= h:
                total, k = 0.0, k + 1
        assert numeric.bar_ids(amounts, h).tolist() == [-1 if i == k else i for i in ids]


def test_lagged_return_is_strictly_before(spark):
    bars = spark.createDataFrame([(1, day(k), c) for k, c in ((0, 1.0), (1, 2.0), (4, 4.0), (5, 8.0))], "code long, ts date, close double")
    assert [(r.ts, r.ret) for r in labeling.lagged_return(bars, 1).orderBy("ts").collect()] == [(day(4), 1.0), (day(5), 3.0)]


def test_barriers(spark):
    bars = closes(spark, [100, 101, 103, 97, 90, 99, 120])
    vol = bars.select("code", "ts", F.lit(0.02).alias("trgt"))
    events = bars.where("close = 100").select("code", F.col("ts").alias("t0"))
    got = labeling.get_events(events, bars, vol, (1, 1), 0.0, 5).first()
    assert (got.t0, got.t1) == (day(0), day(2))
    assert labeling.get_bins(spark.createDataFrame([got]).select("code", "t0", "t1", "trgt", "side"), bars).first().bin == 1


def test_hhi_drawdown_holding(spark):
    r = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0)], "code long, ret double")
    assert stats.hhi(r).first().hhi == pytest.approx(0.0625)
    rows = stats.drawdown(closes(spark, [100, 110, 99, 120, 90]).withColumnRenamed("close", "pnl")).orderBy("ts").collect()
    assert [(x.hwm, round(x.dd, 6)) for x in rows] == [(110, 0.1), (120, 0.25)]
    pos = spark.createDataFrame([(1, day(k), p) for k, p in enumerate([1, 2, 1, -1, 0])], "code long, ts date, pos int")
    # entries 0 and 1 average .5; 1 leaves at 2 (1.5 days), 1 at the flip (2.5), the short after 1 day
    assert stats.holding_period(pos).first().days == pytest.approx((1.5 + 2.5 + 1) / 3)
    assert [x.ts for x in stats.bet_times(pos).orderBy("ts").collect()] == [day(3), day(4)]


def test_peaks(spark):
    highs = [1, 3, 3, 2, 5, 5, 4, 2, 4, 1]
    bars = closes(spark, highs).withColumn("high", F.col("close"))
    assert [r.idx for r in strategy.small_peaks(bars).orderBy("idx").collect()] == [2, 5, 8]
    assert [r.idx for r in strategy.large_peaks(strategy.small_peaks(bars)).orderBy("idx").collect()] == [2, 5, 8]


def test_validation(spark):
    rows = spark.createDataFrame([(k, k, k + 2) for k in range(11)], "row long, t0 long, t1 long")
    sizes = [r["count"] for r in validation.kfold(rows, 3, ["t0"]).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [4, 4, 3]
    folds = validation.purged_kfold(rows, 3, 0.1, ["t0"]).collect()
    for f in range(3):
        test = {r.row for r in folds if r.fold == f and r.role == "test"}
        train = [r for r in folds if r.fold == f and r.role == "train"]
        assert test and not test & {r.row for r in train}
        assert all(r.t1 <= min(test) or r.t0 > max(test) + 1 for r in train)


def test_purge_against_every_pair(spark):
    r = random.Random(1)
    draw = lambda n: [(t, t + r.randint(0, 9)) for t in (r.randint(0, 300) for _ in range(n))]
    train, test = draw(200), draw(12)
    tables = [spark.createDataFrame(x, "t0 long, t1 long") for x in (train, test)]
    got = sorted((x.t0, x.t1) for x in validation.purge(*tables).collect())
    assert got == sorted((a, b) for a, b in train if all(b < c or a > d for c, d in test))
    assert validation.purge(tables[0], tables[1].where("false")).count() == 200 and validation.purge(tables[0].where("false"), tables[1]).count() == 0


def test_paths_end_at_their_barrier(spark):
    """Open, bounded and gapped paths against a scan of all bars."""
    r = random.Random(3)
    days = sorted(r.sample(range(400), 150))
    price = {d: 100 + r.randint(-8, 8) for d in days}
    bars = spark.createDataFrame([(1, day(d), float(p)) for d, p in price.items()], "code long, ts date, close double")
    ends = {d: r.choice([None, d, d + 3, d + 90]) for d in r.sample(days, 40)}
    events = spark.createDataFrame([(1, day(d), day(e) if e is not None else None, 0.05, 1.0) for d, e in ends.items()], "code long, t0 date, t1 date, trgt double, side double")
    for most in (None, 20):
        got = {x.t0: (x.pt, x.sl) for x in labeling.first_touch(events, bars, max_days=most).collect()}
        for d, e in ends.items():
            path = [t for t in days if d <= t and (e is None or t <= e) and (most is None or t <= d + most)]
            hit = lambda f: next((day(t) for t in path if f(price[t] / price[d] - 1)), None)
            assert got[day(d)] == (hit(lambda x: x > 0.05), hit(lambda x: x < -0.05))


def test_prices_of_the_next_bar(spark):
    bars = spark.createDataFrame([(1, day(k), float(k)) for k in (1, 4, 9)], "code long, ts date, close double")
    events = spark.createDataFrame([(1, day(1), day(3)), (1, day(2), day(9)), (1, day(4), day(10)), (2, day(1), day(1))], "code long, t0 date, t1 date").withColumns({"trgt": F.lit(0.1), "side": F.lit(1.0)})
    assert [(x.code, x.t0.day, x.ret, x.bin) for x in labeling.get_bins(events, bars, fill=True).orderBy("code", "t0").collect()] == [(1, 2, 3.0, 1), (1, 3, 1.25, 1), (1, 5, None, None), (2, 2, None, None)]
    assert labeling.get_bins(events, bars).count() == 0


def test_bootstraps_of_text_codes(spark):
    bars = closes(spark, range(100, 110)).withColumn("code", F.lit("T0"))
    events = spark.createDataFrame([("T0", day(k), day(k + 2)) for k in (0, 1, 4, 6)], "code string, t0 date, t1 date")
    drawn = weights.seq_bootstrap(bars, events, seed=3)
    assert drawn.count() == 4 and sorted(map(str, drawn.collect())) == sorted(map(str, weights.seq_bootstrap(bars, events, seed=3).collect()))
    found = weights.bootstrap_mc(bars, events, iters=3).collect()
    assert len(found) == 3 and all(0 < x.standard <= 1 and 0 < x.sequential <= 1 for x in found)
    assert weights.indicator_long(bars, events).count() == 12


def test_trend_lines_against_every_bar(spark):
    r = random.Random(11)
    highs = [200 - k // 2 + r.randint(-6, 6) for k in range(160)]
    rows = spark.createDataFrame([(1, day(k), float(h), float(h - 5)) for k, h in enumerate(highs)], "code long, ts date, high double, low double")
    settings = [(40, 3.0), (25, 20.0)]
    got = {(x.start_idx, x.end_idx, x.length_limited): x.touches for x in strategy.trend_line_sweep(rows, settings).collect()}
    peaks = [x.idx for x in strategy.large_peaks(strategy.small_peaks(rows)).collect()]
    want = {}
    for limit, rate in settings:
        tol = int(max(highs) - min(highs) + 5) * rate / 100
        for s in peaks:
            for e in peaks:
                if s < e and len(highs) - e <= limit and highs[e] <= highs[s]:
                    above = {i: highs[i] - (highs[s] + (highs[e] - highs[s]) / (e - s) * (i - s)) for i in range(s + 1, e)}
                    touches = sum(abs(above[i]) < tol for i in peaks if s < i < e)
                    if all(x < tol for x in above.values()) and touches:
                        want[s, e, limit] = touches
    assert want and got == want


def test_rank_and_reward(spark):
    rows = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.2)], "row long, pred double")
    assert [r.rank for r in scoring.pct_rank_first(rows).orderBy("row").collect()] == pytest.approx([1 / 3, 1, 2 / 3])
    picks = spark.createDataFrame([("m", 1, "2020-01-02")], "method string, code long, data_range_end string")
    bars = closes(spark, [1, 2, 3, 4])
    assert reward.reward(picks, bars, 2).first().reward_rates == [0.0, 0.5]
    assert reward.reward(picks, bars, -1).first().reward_rates == [0.5, 1.0]
    none = reward.reward(picks, bars, 0).first()
    assert none.reward_rates == [] and none.reward_rate_mean is None


def test_norm_cdf(spark):
    import math

    rows = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double").select("x", betting.norm_cdf(F.col("x")).alias("p"))
    assert all(abs(r.p - (1 + math.erf(r.x / math.sqrt(2))) / 2) < 2e-7 for r in rows.collect())


def test_feature_groups(spark):
    wide = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "feature_wisdom1 double, feature_wisdom2 double, feature_charisma1 double, target double")
    assert {r["group"]: r.n for r in scoring.feature_group_counts(wide).collect()} == {"wisdom": 2, "charisma": 1}


def test_files(spark, tmp_path):
    from tidewright.sources import io

    (tmp_path / "1332.csv").write_text("Date,Open,High,Low,Close,Adj_Close,Volume\n2017-01-04,568,576,563,571,571,2798500\n")
    row = io.read_bars_csv(spark, str(tmp_path / "1332.csv")).first()
    assert (row.code, row.close, row.volume) == ("1332", 571.0, 2798500)
    results = spark.createDataFrame([(["1332", "2990"], "test", "a", "b", "c", 0, 1.0)], io.SELECTION)
    io.write_selection_json(results, str(tmp_path / "out"))
    flat = clean.flatten_selection(io.read_selection_json(spark, str(tmp_path / "out")), "u/").orderBy("code").collect()
    assert [(r.code, r.image_url) for r in flat] == [("1332", "u/test_1332.png"), ("2990", "u/test_2990.png")]
    io.write_stage(closes(spark, [1, 2]), str(tmp_path), "labeled")
    assert io.read_stage(spark, str(tmp_path), "labeled").count() == 2


def test_streamed_bars(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 1, d, h), k, float(10 * d + h), 2) for k, (d, h) in enumerate([(1, 9), (1, 8), (2, 9), (1, 10), (5, 9), (9, 9)])]
    schema = "code long, ts timestamp, seq long, price double, size long"
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.write_bars(refresh.daily_bars(stream), str(tmp_path / "bars"), str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "bars")).orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.volume) for r in got][0] == (dt.date(2020, 1, 1), 18.0, 20.0, 18.0, 20.0, 6)
    assert [r.ts.day for r in got] == [1, 2, 5]  # the last day stays open until the watermark passes it


def test_empty_tables(spark):
    empty = closes(spark, [])
    assert B.cusum_events(empty, 1.0).count() == 0
    assert labeling.daily_vol(empty, 1).count() == 0
    assert strategy.ma_ranking(empty.withColumns({"open": F.col("close"), "low": F.col("close"), "high": F.col("close")})).count() == 0


def test_model_queries_read_whole_tables(spark, tmp_path):
    """Every vector is fitted and predicted, all embedding columns are ranked, bars of all years are classified."""
    from tidewright.plans import model_queries as Q

    rows = [(k, k % 10, [((k * (j + 3)) % 17) / 17 for j in range(64)]) for k in range(120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = str(tmp_path)
    assert {r.row for r in Q.e1_forest(spark, d).collect()} == {r.row for r in Q.n4_gbt(spark, d).collect()} == set(range(120))
    assert Q.e3_mdi(spark, d).count() == len(Q.NAMES) == 64
    asked = {}
    ask = lambda name: lambda estimator, folds, names, k: asked.update({name: list(names)})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Q.M, "mda", ask("mda"))
        patch.setattr(Q.M, "sfi", ask("sfi"))
        Q.e4_mda(spark, d), Q.e5_sfi(spark, d)
        assert asked == {"mda": Q.NAMES, "sfi": Q.NAMES}
        seen = []
        patch.setattr(Q, "bars", lambda *_: spark.sql("SELECT DATE '1993-01-01' AS ts"))
        patch.setattr(Q, "pct_change", lambda rows: seen.extend(rows.collect()) or (_ for _ in ()).throw(StopIteration))
        with pytest.raises(StopIteration):
            Q.d9_sequence_clf(spark, d)
        assert len(seen) == 1
