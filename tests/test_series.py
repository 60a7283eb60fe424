"""Series in chunks: one key over many tasks gives the rows of one pass."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import numeric
from tidewright.functions.series import PART, Chunks
from tidewright.functions.shared import Scratch, keep, shared_folder
from tidewright.operators import bars as B
from tidewright.operators import fracdiff, labeling, stats
from tidewright.operators import indicators as I
from tidewright.operators import models as M
from tidewright.operators import validation as V

DAY = dt.date(2000, 1, 1)
day = lambda k: DAY + dt.timedelta(days=int(k))


def test_chunks_of_one_key(spark):
    rows = spark.range(1000).select(F.lit(7).alias("code"), F.col("id").alias("ts")).unionByName(spark.range(3).select((F.col("id") + 90).cast("int").alias("code"), F.col("id").alias("ts")))
    chunks = Chunks(rows, ["code"], ["ts"], 6)
    parts = chunks.linked()[(7,)]
    assert len(parts) >= 4 and sum(p["n"] for p in parts) == 1000 and list(chunks.linked()) == [(7,)]
    ends = [(r.a, r.b) for r in chunks.rows.where("code = 7").groupBy(PART).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy(PART).collect()]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_scratch_leaves_nothing(spark, tmp_path):
    import os

    before = set(os.listdir(shared_folder(spark).removeprefix("file://"))) if os.path.isdir(shared_folder(spark)) else set()
    with Scratch(spark) as outer:
        with Scratch(spark):
            keep(spark.range(5), "inner")
        table = keep(spark.range(5), "outer")
        assert len(outer.paths) == 1
        table.write.parquet(str(tmp_path / "out"))
    assert set(os.listdir(shared_folder(spark).removeprefix("file://"))) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def ticks(spark, by_symbol):
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=k), k, p, q) for s, ts in by_symbol.items() for k, (p, q) in enumerate(ts)]
    return spark.createDataFrame(rows, "symbol long, ts timestamp, seq long, price double, size long")


def plain_bars(trades, threshold, new_day=lambda k: False):
    out, held, total, number = [], [], 0, 0
    for k, (p, q) in enumerate(trades):
        if k and new_day(k):
            held, total, number = [], 0, 0
        held.append((p, q))
        total += round(p * q * 1e6)
        if total >= threshold * 1e6:
            ps = [x for x, _ in held]
            out.append((number, ps[0], max(ps), min(ps), ps[-1], sum(y for _, y in held)))
            held, total, number = [], 0, number + 1
    return out


@pytest.mark.parametrize("kind", ["random", "equal", "zeros", "rare"])
def test_dollar_bars_of_one_symbol_in_many_tasks(spark, kind):
    r = random.Random(kind)
    hot = {
        "random": [(round(r.uniform(1, 50), 2), r.randint(0, 9)) for _ in range(900)],
        "equal": [(10.0, 1)] * 700,
        "zeros": [(r.choice([0.0, 0.0, 40.0]), r.randint(1, 3)) for _ in range(800)],
        "rare": [(1.0, 1)] * 600 + [(500.0, 1)] * 3,
    }[kind]
    by_symbol = {1: [(5.0, 2)] * 30, 2: hot, 3: [(100.0, 1)] * 2, 4: [(1.0, 1)]}
    limit = {"random": 333.33, "equal": 25.0, "zeros": 100.0, "rare": 700.0}[kind]
    got = {}
    for x in B.dollar_bars(ticks(spark, by_symbol), limit, ranges=7).orderBy("symbol", "bar_id").collect():
        got.setdefault(x.symbol, []).append((x.bar_id, x.open, x.high, x.low, x.close, x.volume))
    assert got == {s: plain_bars(t, limit) for s, t in by_symbol.items() if plain_bars(t, limit)}


def test_daily_dollar_bars(spark):
    r = random.Random(1)
    trades = [(round(r.uniform(1, 9), 2), 1) for _ in range(4000)]  # a minute apart: nearly three days
    got = [(x.bar_id, x.open, x.high, x.low, x.close, x.volume) for x in B.dollar_bars(ticks(spark, {1: trades}), 200.0, "daily", ranges=5).orderBy("day", "bar_id").collect()]
    assert got == plain_bars(trades, 200.0, lambda k: k % 1440 == 0)


def bars_in_doubles(trades, threshold):
    """As the queries' SQL: a double that restarts at 0 after each bar."""
    out, held, total = [], [], 0.0
    for p, q in trades:
        held.append(q)
        total += p * q
        if total >= threshold:
            out.append((len(out), len(held), sum(held)))
            held, total = [], 0.0
    return out


@pytest.mark.parametrize("limit, price", [(1.0, lambda r: 0.1), (1.0, lambda r: r.choice([0.0, 0.1, 0.2, 0.3])), (30.0, lambda r: r.choice([0.1, 0.7, 1.1])), (0.05, lambda r: 0.1)])
@pytest.mark.parametrize("reset", ["exact", "daily"])
def test_dollar_bars_add_up_one_by_one(spark, reset, limit, price):
    """Ten times 0.1 is less than 1 in doubles, so a bar of 1 has eleven trades, also where it is cut."""
    r = random.Random(2)
    trades = [(price(r), r.randint(1, 2) if limit > 1 else 1) for _ in range(1300)]
    rows = [(1, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=k), k, p, q) for k, (p, q) in enumerate(trades)]
    table = spark.createDataFrame(rows, "symbol long, ts timestamp, seq long, price double, size long")
    got = B.dollar_bars(table, limit, reset, ranges=9).orderBy("bar_id").collect()
    want = bars_in_doubles(trades, limit)
    assert [(x.bar_id, x.volume) for x in got] == [(k, volume) for k, _, volume in want]


def test_cumulative_bars_are_cut_at_exact_sums(spark):
    """In doubles ten times 0.1 is less than 1 and thirty times 0.1 more than 3, so bars would have eleven trades or nine."""
    trades = [(0.1, 1)] * 1000 + [(2.5, 1), (-3.0, 1), (0.1, 1)]
    got = B.dollar_bars(ticks(spark, {1: trades, 2: [(7e12, 2)] * 3}), 1.0, "cumulative").orderBy("symbol", "bar_id").collect()
    assert [(x.bar_id, x.volume) for x in got if x.symbol == 1] == [(k, 10) for k in range(99)] + [(99, 11), (100, 1), (102, 1)]
    assert [(x.bar_id, x.volume) for x in got if x.symbol == 2] == [(0, 2), (14 * 10**12, 2), (28 * 10**12, 2)]


def test_links_of_chunks_carry_doubles():
    rng = np.random.default_rng(8)
    for _ in range(200):
        amounts, limit = rng.integers(0, 5, rng.integers(1, 60)) * rng.choice([0.1, 0.01, 1.3]), rng.integers(1, 30) * 0.1
        last, bars = numeric.bar_starts(amounts, limit)[1:]
        head, made, left, tail = numeric.bar_links(amounts, limit)
        for entering in [0.0, *(rng.random(6) * limit), limit - 0.1 if limit > 0.1 else 0.0]:
            held, n, first = entering, 0, None
            for k, a in enumerate(amounts):
                held += a
                if held >= limit:
                    held, n, first = 0.0, n + 1, k if first is None else first
            sums = np.cumsum(np.r_[entering, head])
            k = int(np.searchsorted(sums, limit)) - 1
            assert (n, held) == ((made[k], np.cumsum(np.r_[0.0, tail[len(tail) - left[k] :]])[-1]) if k < len(head) else (0, sums[-1]))
            if first is not None:
                assert 1 + bars[first + 1] == n and np.cumsum(np.r_[0.0, amounts[last[first + 1] :]])[-1] == held


def test_bar_functions_say_what_a_chunk_does():
    rng = np.random.default_rng(5)
    for _ in range(60):
        amounts, limit = rng.integers(0, 6, rng.integers(1, 40)), int(rng.integers(1, 25))
        need, bars, left, total = numeric.bar_function(amounts, limit)
        for entering in range(limit):
            held, made = entering, 0
            for a in amounts:
                held += a
                if held >= limit:
                    held, made = 0, made + 1
            k = int(np.searchsorted(-need, -entering))
            assert (made, held) == ((bars[k], left[k]) if k < len(need) else (0, entering + total))


def plain_cusum(values, h):
    up = down = 0
    for i in range(1, len(values)):
        up, down = max(0, up + values[i] - values[i - 1]), min(0, down + values[i] - values[i - 1])
        if down < -h:
            down = 0
            yield i
        elif up > h:
            up = 0
            yield i


@pytest.mark.parametrize("h", [1, 9, 40, 10**6])
def test_cusum_of_one_code_in_many_tasks(spark, h):
    r = random.Random(h)
    series = {1: [r.randint(0, 90) for _ in range(40)], 2: list(np.cumsum([r.randint(-4, 4) for _ in range(1500)])), 3: [5]}
    rows = [(c, day(k), float(v)) for c, vs in series.items() for k, v in enumerate(vs)]
    rows += [(2, day(5000), None)]
    table = spark.createDataFrame(rows, "code long, ts date, close double")
    got = sorted((x.code, x.t0) for x in B.cusum_events(table, float(h), ranges=8).collect())
    assert got == sorted((c, day(k)) for c, vs in series.items() for k in plain_cusum(vs, h))


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("gap", [0, 1, 40])
def test_weighted_deviation_of_one_code_in_many_tasks(spark, gap):
    """Bars every few hours, every day, and with long holes; also where a chunk's reach begins chunks before it."""
    r = random.Random(gap)
    hours = np.cumsum([r.choice([1, 2, 24 * gap or 1]) for _ in range(1800)])
    times = [dt.datetime(2000, 1, 1) + dt.timedelta(hours=int(k)) for k in hours]
    series = {1: (times, 100 + np.cumsum(np.random.default_rng(1).normal(0, 1, 1800))), 2: (times[:5], np.arange(5) + 9.0)}
    table = spark.createDataFrame([(c, t, float(v)) for c, (ts, vs) in series.items() for t, v in zip(ts, vs)], "code long, ts timestamp, close double")
    want = {}
    for c, (ts, vs) in series.items():
        days = [(t.date() - DAY).days for t in ts]
        refs = [max((j for j in range(i) if days[j] <= days[i] - 3), default=None) for i in range(len(ts))] if len(ts) < 10 else [int(np.searchsorted(days, d - 2)) - 1 for d in days]
        kept = [(t, v / vs[j] - 1) for t, v, j in zip(ts, vs, refs) if j is not None and j >= 0]
        dev = pd.Series([x for _, x in kept], dtype=float).ewm(span=6).std()
        want |= {(c, t): d for (t, _), d in zip(kept, dev) if d == d}
        returns = {(c, t): x for t, x in kept}
        got = {(x.code, x.ts): x.ret for x in labeling.lagged_return(table, 2, ranges=9).where(F.col("code") == c).collect()}
        assert got == pytest.approx(returns)
    found = labeling.daily_vol(table, 2, span=6, ranges=9)
    assert "Python" not in plan_of(found) and "InPandas" not in plan_of(found) and "InArrow" not in plan_of(found)
    assert {(x.code, x.ts): x.trgt for x in found.collect()} == pytest.approx(want, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("clock", [False, True])
def test_fractional_differences_of_one_code_in_many_tasks(spark, clock):
    r = random.Random(3)
    make = lambda n, empty: [None] * empty + [None if r.random() < 0.1 else 100 + r.random() for _ in range(n - empty)]
    series = {1: (make(900, 210), make(900, 3)), 2: (make(30, 2), make(30, 0)), 3: ([None] * 4, [1.0] * 4)}
    at = (lambda k: dt.datetime(2000, 1, 1) + dt.timedelta(minutes=k)) if clock else day
    table = spark.createDataFrame([(c, at(k), a, b) for c, (x, y) in series.items() for k, (a, b) in enumerate(zip(x, y))], f"code long, ts {'timestamp' if clock else 'date'}, a double, b double")

    def plain(values, sums, skip):
        x = pd.Series(values, dtype=float).ffill().dropna().to_numpy()
        begin = len(values) - len(x)
        return {begin + i: sums(x, i) for i in range(skip(len(x)), len(x)) if values[begin + i] is not None}

    w = fracdiff.weights_ffd(0.4, 1e-2)
    fixed = lambda x, i: float(w @ x[i - len(w) + 1 : i + 1][::-1])
    grown = lambda x, i: float(fracdiff.weights(0.4, i + 1) @ x[: i + 1][::-1])
    for found, sums, skip in (
        (fracdiff.frac_diff_ffd(table, ["a", "b"], 0.4, 1e-2, ranges=8), fixed, lambda n: len(w) - 1),
        (fracdiff.frac_diff(table, ["a", "b"], 0.4, 0.2, ranges=8), grown, lambda n: fracdiff.unsettled(0.4, n, 0.2) if n else 0),
    ):
        got = {(x.code, x.ts): (x.fd_a, x.fd_b) for x in found.collect()}
        want = {}
        for c, (a, b) in series.items():
            fa, fb = plain(a, sums, skip), plain(b, sums, skip)
            want |= {(c, at(k)): (fa[k], fb[k]) for k in fa.keys() & fb.keys()}
        assert got.keys() == want.keys() and len(got) > 300
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_long_convolutions():
    rng = np.random.default_rng(2)
    for n, m in ((3, 5), (300, 4000), (5000, 6000)):
        x, w = rng.normal(size=n), rng.normal(size=m)
        assert numeric.convolved(x, w) == pytest.approx(np.convolve(x, w), abs=1e-9)
    w = fracdiff.weights(0.5, 1_000_000)
    began = time.perf_counter()
    assert len(numeric.convolved(rng.normal(size=1_000_000), w)) == 1_999_999 and time.perf_counter() - began < 10


def brute_draws(first, last, draws, rng):
    depth, out = np.zeros(int(last.max()) + 1), []
    for _ in range(draws):
        u = np.array([(1 / (depth[a : b + 1] + 1)).mean() for a, b in zip(first, last)])
        out.append(rng.choice(len(first), p=u / u.sum()))
        depth[first[out[-1]] : last[out[-1]] + 1] += 1
    return out


@pytest.mark.parametrize("longest", [1, 6, 60])
def test_sequential_draws_have_the_same_distribution(longest):
    """The same random numbers give the same draws as a pass over all events, in order of their first bar, for each."""
    rng = np.random.default_rng(longest)
    first = rng.integers(0, 90, 70)
    last = first + rng.integers(0, longest, 70)
    order = np.argsort(first, kind="stable")
    got = numeric.draw_sequential(first, last, 150, np.random.default_rng(8))
    assert got.tolist() == order[brute_draws(first[order], last[order], 150, np.random.default_rng(8))].tolist()
    assert numeric.draw_sequential(np.array([0, 2, 4]), np.array([2, 3, 5]), 3, np.random.default_rng(1)).tolist() == brute_draws(
        np.array([0, 2, 4]), np.array([2, 3, 5]), 3, np.random.default_rng(1)
    )


def test_first_draws_of_the_golden_events():
    """After event 0 of {0:2, 2:3, 4:5} uniqueness is 5/6 : 9/12 : 1 of what it was alone."""
    unique = [(1 / 2 + 1 / 2 + 1 / 2) / 3, (1 / 2 + 1) / 2, 1.0]
    tree = numeric.SumTree(np.ones(3))
    tree.change(0, np.array(unique))
    share = np.cumsum(unique) / sum(unique)
    assert [tree.find(x) for x in (0.0, share[0] - 1e-9, share[0] + 1e-9, share[1] + 1e-9, 0.999999)] == [0, 0, 1, 2, 2]


def test_sum_tree_against_cumulative_sums():
    rng = np.random.default_rng(6)
    weights = rng.random(5000)
    tree = numeric.SumTree(weights)
    for _ in range(300):
        a = int(rng.integers(0, 4990))
        weights[a : a + 10] = rng.random(10) * (rng.random(10) < 0.5)
        tree.change(a, weights[a : a + 10].copy())
        share = rng.random()
        assert tree.find(share) == np.searchsorted(weights.cumsum(), share * weights.sum(), "right")


def test_a_hundred_thousand_events_are_drawn_in_a_minute():
    rng = np.random.default_rng(0)
    first = np.sort(rng.integers(0, 400_000, 100_000))
    began = time.perf_counter()
    drawn = numeric.draw_sequential(first, first + rng.integers(1, 30, 100_000), 100_000, rng)
    assert len(drawn) == 100_000 and time.perf_counter() - began < 60


def test_rule_sums_against_every_rule():
    r = random.Random(4)
    moves = [[float(r.randint(-9, 9)) for _ in range(r.randint(1, 12))] for _ in range(200)]
    takes, stops = np.array([0.0, 2, 3, 8, 50]), np.array([1.0, 4, 5, 60])
    got = numeric.grid_sums(moves, takes, stops)
    for i, pt in enumerate(takes):
        for j, sl in enumerate(stops):
            gains = [next((x for x in m if x > pt or x < -sl), m[-1]) for m in moves]
            assert got[:, i, j].tolist() == [200, sum(gains), sum(x * x for x in gains)]


def test_a_large_rule_grid_costs_little_more(spark):
    rows = spark.createDataFrame([(1, day(k), 100.0 + (k * 37) % 23 - 11) for k in range(4000)], "code long, ts date, close double")
    bars = keep(rows, "bars")
    events = bars.select("code", F.col("ts").alias("t0"))
    grid = lambda n: [(float(a), float(b)) for a in range(1, n + 1) for b in range(1, n + 1)]
    seconds = {}
    for n in (3, 21, 3, 21):
        began = time.perf_counter()
        assert stats.rule_grid(events, bars, grid(n), 20).count() == n * n
        seconds[n] = time.perf_counter() - began
    assert seconds[21] < 3 * seconds[3]


def plain_holding(pos):
    entry = prev = num = den = 0.0
    for k, p in enumerate(pos):
        if (p - prev) * prev >= 0:
            entry = (entry * prev + k * (p - prev)) / p if p else entry
        else:
            amount = abs(prev) if p * prev < 0 else abs(p - prev)
            num, den = num + (k - entry) * amount, den + amount
            entry = k if p * prev < 0 else entry
        prev = p
    return num / den if den else None


def test_holding_period_of_one_code_in_many_tasks(spark):
    r = random.Random(9)
    series = {1: [r.choice([-2, -1, 0, 1, 2, 3]) for _ in range(700)], 2: [1 + k % 2 for k in range(3000)] + [0], 3: [0, 1, 1], 4: [0.0]}
    rows = spark.createDataFrame([(c, day(k), float(p)) for c, ps in series.items() for k, p in enumerate(ps)], "code long, ts date, pos double")
    got = {x.code: x.days for x in stats.holding_period(rows, ranges=7, block=16).collect()}
    assert got == pytest.approx({c: plain_holding(ps) for c, ps in series.items()})


@pytest.mark.parametrize("leave_own", [True, False])
def test_neighbours_are_exact_and_most_distances_are_not_taken(spark, monkeypatch, leave_own):
    """All vectors as queries, in clusters; small blocks; ties by id."""
    monkeypatch.setattr(I, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(12, 6))[rng.integers(0, 12, 500)] * 9 + rng.normal(size=(500, 6)), 1)
    x[40:60] = x[40]  # copies
    table = spark.createDataFrame([(i, int(i % 3), [float(v) for v in row]) for i, row in enumerate(x)], "r long, y int, x array<double>")
    near, tested = I.neighbours(table, table.select(F.col("r").alias("row"), F.col("x").alias("q")), 5, leave_own)
    got = {}
    for n in near.orderBy("row", "d", "r").collect():
        got.setdefault(n.row, []).append(n.r)
    for i in range(500):
        d = ((x - x[i]) ** 2).cumsum(1)[:, -1]
        order = [j for j in sorted(range(500), key=lambda j: (d[j], j)) if j != i or not leave_own]
        assert got[i] == order[:5]
    assert tested.agg(F.sum("tested")).first()[0] < 500 * 500 / 3


def test_neighbours_where_cells_are_small(spark):
    table = spark.createDataFrame([(i, i, [float(i)]) for i in range(6)], "r long, y int, x array<double>")
    ask = lambda points, k: sorted((n.row, n.r) for n in I.neighbours(points, table.select(F.col("r").alias("row"), F.col("x").alias("q")), k)[0].collect())
    assert ask(table, 50) == [(a, b) for a in range(6) for b in range(6)]
    assert ask(table.limit(0), 2) == []


@pytest.mark.parametrize("kind", ["normal", "grid", "far", "tiny", "outlier", "copies"])
@pytest.mark.parametrize("leave_own", [True, False])
def test_closest_is_exact_where_single_precision_is_not(kind, leave_own):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5))
    x = {"normal": x, "grid": np.round(x), "far": x + 1e7, "tiny": x * 1e-30, "outlier": np.r_[x[:-1], [[1e25] * 5]], "copies": np.repeat(x[:7], 100, 0)}[kind]
    ids, pivot = rng.permutation(700), x[3]
    dist = np.sqrt(((x - pivot) ** 2).sum(1))
    by = np.argsort(dist)
    x, ids, dist = x[by], ids[by], dist[by]
    q = x[::3]
    for reach in (np.inf, float(np.median(dist)) * (1 + 1e-9)):  # as much more as the index adds
        i, j, d, _ = numeric.closest(q, dist[::3], np.full(len(q), reach), x, dist, ids, 6, ids[::3] if leave_own else None, 5000)
        for a in range(len(q)):
            away = np.cumsum((x - q[a]) ** 2, axis=1)[:, -1]
            want = [b for b in np.lexsort((ids, away)) if away[b] <= reach * reach * (1 - 1e-9) and not (leave_own and ids[b] == ids[3 * a])][:6]
            assert j[i == a][: len(want)].tolist() == want and d[i == a][: len(want)].tolist() == away[want].tolist()
    kept = numeric.first_copies(x, ids, 2)
    assert sorted(ids[kept]) == sorted(r for v in np.unique(x, axis=0) for r in sorted(ids[(x == v).all(1)])[:2])


def test_neighbours_of_many_vectors_without_clusters(spark):
    """All pairs of 12,000 vectors: a microsecond or more for each pair takes minutes."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 64))
    x[500:520, 3] = np.nan
    table = spark.createDataFrame(pd.DataFrame({"r": np.arange(12_000), "y": np.arange(12_000) % 3, "x": x.tolist()}), "r long, y long, x array<double>")
    began = time.perf_counter()
    near = I.neighbours(table, table.select(F.col("r").alias("row"), F.col("x").alias("q")), 7, leave_own=True)[0].groupBy("row").agg(F.sort_array(F.collect_list(F.struct("d", "r"))).alias("n"))
    got = {n.row: [a.r for a in n.n] for n in near.collect()}
    assert time.perf_counter() - began < 60
    assert set(got) == {*range(500), *range(520, 12_000)}
    for i in range(0, 12_000, 97):
        if i in got:
            d = np.cumsum((x - x[i]) ** 2, axis=1)[:, -1]
            d[i] = np.inf
            assert got[i] == np.lexsort((np.arange(12_000), d))[:7].tolist()


NAMES = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def folds(spark):
    noise = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000
    table = spark.range(400).select(F.col("id").alias("row"), F.col("id").alias("t0"), (F.col("id") + 2).alias("t1"), *[noise(k).alias(n) for k, n in enumerate(NAMES)])
    table = table.withColumn("label", (F.col("x0") + F.col("x1") * 0.3 > 0.6).cast("double"))
    return V.purged_kfold(table, 2, 0.01, ["t0"]).cache()


@pytest.mark.parametrize("scoring", ["accuracy", "logLoss"])
def test_swapped_columns_score_as_the_model_does(folds, scoring):
    test = folds.where("fold = 0 AND role = 'test'")
    model = M.forest(6, 4).fit(M.assemble(folds.where("fold = 0 AND role = 'train'"), NAMES))
    trees = M.tree_arrays(model)
    assert len(trees) == 6
    got = {r.feature: r.score for r in M._swapped_scores(trees, M._partners(test, NAMES, 3), 3, scoring).collect()}
    want = model.transform(M.permuted(test, NAMES, 3)).groupBy("feature").agg(F.avg(M._score(scoring)).alias("score"))
    assert got == pytest.approx({r.feature: r.score for r in want.collect()})


def test_single_features_score_near_the_fits(folds):
    found = {r.feature: r["mean"] for r in M.sfi(M.forest(5, 3), folds, NAMES, 2).collect()}
    for name in NAMES:
        fits = V.cv_score(M.forest(5, 3), M.assemble(folds, [name]), 2, "accuracy")
        assert abs(found[name] - sum(fits) / 2) < 0.06
    assert found["x0"] > 0.75 > found["x2"]


def test_trees_on_bins():
    counts = np.array([[9, 0], [8, 1], [0, 5], [0, 7], [6, 0], [5, 0]], float)
    share = M.grow_on_bins(counts, 2)
    assert share.argmax(1).tolist() == [0, 0, 1, 1, 0, 0] and share[2].tolist() == [0, 1]
    assert M.grow_on_bins(counts, 0).tolist() == [[28 / 41, 13 / 41]] * 6
