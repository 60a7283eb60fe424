"""Queries of labels, weights, fractional differences and purged validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import keep
from ..operators import fracdiff as D
from ..operators import labeling as L
from ..operators import validation as V
from ..operators import weights as W
from ..operators.bars import cusum_events
from ..sources.adapters import BARS_SQL, bars
from .common import longs, r6, rounded
from .source_queries import cusum_sql

H, DAYS, MIN_RET = 30.0, 5, 0.003


def l1_asof(spark, d):
    return rounded(L.lagged_return(bars(spark, d), DAYS), "ret")


def l2_ewm(spark, d):
    return rounded(L.daily_vol(bars(spark, d), DAYS), "trgt")


def l3_vertical(spark, d):
    rows = bars(spark, d)
    return L.vertical_barrier(cusum_events(rows, H), rows, DAYS)


def l6_first_touch(spark, d):
    rows = keep(bars(spark, d), "bars")
    events = L.vertical_barrier(cusum_events(rows, H), rows, 30).withColumns({"trgt": F.lit(0.01), "side": F.lit(1.0)})
    return L.first_touch(events, rows).select("code", "t0", "t1", "pt", "sl")


def _events(spark, d):
    """Bars and events, each derived once for all that a query makes of them."""
    rows = keep(bars(spark, d), "bars")
    return rows, keep(L.get_events(cusum_events(rows, H), rows, L.daily_vol(rows, DAYS), (1.0, 1.0), MIN_RET, DAYS), "events")


def l7_events(spark, d):
    return _events(spark, d)[1].select("code", "t0", "t1")


def l8_bins(spark, d):
    rows, events = _events(spark, d)
    return rounded(L.get_bins(events, rows), "ret")


def l8_filled(spark, d):
    """Bins of events that end three days after they begin, on a bar or not: prices are those of the next bar, if any."""
    rows, events = _events(spark, d)
    ends = events.select("code", "t0", F.date_add("t0", 3).alias("t1"), "trgt", "side")
    return rounded(L.get_bins(ends, rows, fill=True).where("ret IS NOT NULL"), "ret")


def l8_meta_bins(spark, d):
    """Meta-labels: each event's side is the direction of its own bar."""
    rows = keep(bars(spark, d), "bars")
    cusum = cusum_events(rows, H)
    side = F.when(F.col("close") >= F.col("open"), 1.0).otherwise(-1.0).alias("side")
    events = L.get_events(cusum, rows, L.daily_vol(rows, DAYS), (1.0, 2.0), MIN_RET, DAYS, rows.select("code", F.col("ts").alias("t0"), side))
    return rounded(L.get_bins(events, rows, meta=True), "ret")


def l9_drop(spark, d):
    rows, events = _events(spark, d)
    return L.drop_rare_labels(L.get_bins(events, rows), 0.3).select("code", "t0", "bin")


def l10_label(spark, d):
    return rounded(L.label(keep(bars(spark, d), "bars"), H, DAYS, (1.0, 1.0), MIN_RET, 0.3), "ret")


def w1_concurrency(spark, d):
    return longs(W.concurrency(*_events(spark, d)), "c")


def _weighted(spark, d):
    rows, events = _events(spark, d)
    return rows, W.avg_uniqueness(rows, events)


def w2_uniqueness(spark, d):
    return rounded(_weighted(spark, d)[1].select("code", "t0", "tw"), "tw")


def w3_return_w(spark, d):
    return rounded(W.return_weights(*_events(spark, d)).select("code", "t0", "w"), "w")


def w4_norm(spark, d):
    return rounded(W.normalise(W.return_weights(*_events(spark, d))).select("code", "t0", "w"), "w")


def w5_decay(spark, d):
    return rounded(W.time_decay(_weighted(spark, d)[1]).select("code", "t0", "decay"), "decay")


def w6_ind(spark, d):
    return W.indicator_long(*_events(spark, d))


def w7_avg_u(spark, d):
    rows, events = _events(spark, d)
    return rounded(W.ind_uniqueness(W.indicator_long(rows, events), rows), "u")


def w8_bootstrap(spark, d):
    return W.seq_bootstrap(*_events(spark, d), seed=7)


def w9_mc(spark, d):
    return rounded(W.bootstrap_mc(*_events(spark, d), iters=5, seed=7), "standard", "sequential")


def w10_rows(spark, d):
    rows, events = _events(spark, d)
    return W.bootstrap_rows(L.get_bins(events, rows), W.seq_bootstrap(rows, events, seed=7)).select("code", "t0", "bin")


def w10_fixed(spark, d):
    """Bins of the events that a fixed list of draws holds, which draws an event as often as its day says, from no time to four times."""
    rows, events = _events(spark, d)
    draws = events.select("code", "t0", F.explode(F.sequence(F.lit(0), F.dayofmonth("t0") % 5)).alias("draw")).where("draw > 0")
    return W.bootstrap_rows(L.get_bins(events, rows), draws).select("code", "t0", "bin")


def f1_weights(spark, d):
    """Weights of one degree per nation: k / 25 for its number."""
    table = D.weight_table(spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") / 25).alias("d")), 6)
    return table.select(r6("d").alias("d"), F.col("k").cast("long").alias("k"), r6("w", 9).alias("w"))


def f3_ffd(spark, d):
    return rounded(D.frac_diff_ffd(bars(spark, d), ["close"], 0.5, 1e-3), "fd_close")


def f4_frac(spark, d):
    return rounded(D.frac_diff(bars(spark, d), ["close"], 0.5, 0.3), "fd_close")


def f5_sample(spark, d):
    rows, events = _events(spark, d)
    sampled = D.sample_features(events, L.get_bins(events, rows), D.frac_diff_ffd(rows, ["close"], 0.5, 1e-3))
    return rounded(sampled.select("code", "t0", "bin", "fd_close"), "fd_close")


def _observations(spark, d):
    return _events(spark, d)[1].where("t1 IS NOT NULL").select("code", "t0", "t1")


def c1_purge(spark, d):
    rows = _observations(spark, d)
    return V.purge(rows, rows.where("code = 3").select("t0", "t1"))


def c2_embargo(spark, d):
    return V.embargo(bars(spark, d).select("ts").distinct(), 0.05)


def c3_kfold(spark, d):
    return V.kfold(_observations(spark, d), 5, ["t0", "code"]).select("code", "t0", "fold")


def c4_purged_kfold(spark, d):
    return V.purged_kfold(_observations(spark, d), 5, 0.01, ["t0", "code"]).select("code", "t0", "fold", "role")


def c6_describe(spark, d):
    rows, events = _events(spark, d)
    names = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return rounded(V.describe(L.get_bins(events, rows), "ret"), *names)


def c6_hist(spark, d):
    rows, events = _events(spark, d)
    return V.label_histogram(L.get_bins(events, rows), "bin")


QUERIES = {
    f.__name__: f
    for f in (
        l1_asof, l2_ewm, l3_vertical, l6_first_touch, l7_events, l8_bins, l8_filled, l8_meta_bins, l9_drop, l10_label, w1_concurrency, w2_uniqueness,
        w3_return_w, w4_norm, w5_decay, w6_ind, w7_avg_u, w8_bootstrap, w9_mc, w10_rows, w10_fixed, f1_weights, f3_ffd, f4_frac, f5_sample, c1_purge,
        c2_embargo, c3_kfold, c4_purged_kfold, c6_describe, c6_hist,
    )
}

_VOL = f"""ret AS (
  SELECT * FROM (SELECT code, ts, close / last_value(close) OVER (PARTITION BY code ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {DAYS + 1} DAY PRECEDING) - 1 AS ret FROM bars)
  WHERE ret IS NOT NULL
), rn AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS n FROM ret),
sums AS (
  SELECT code, ts, n, pow(99 / 101, n) * sum(pow(99 / 101, -n) * ret) OVER w AS sx, pow(99 / 101, n) * sum(pow(99 / 101, -n) * ret * ret) OVER w AS sxx,
    (1 - pow(99 / 101, n)) / (1 - 99 / 101) AS sw, (1 - pow(99 / 101, 2 * n)) / (1 - pow(99 / 101, 2)) AS sw2
  FROM rn WINDOW w AS (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING)
), vol AS (
  SELECT code, ts, sqrt(greatest(sxx / sw - pow(sx / sw, 2), 0) * sw * sw / (sw * sw - sw2)) AS trgt FROM sums WHERE n > 1
)"""
_BASE = f"WITH RECURSIVE {BARS_SQL}, {cusum_sql(30)}"


def _vertical(days: int) -> str:
    return f"(SELECT code, ts AS t0, min(ts) OVER (PARTITION BY code ORDER BY ts RANGE BETWEEN INTERVAL {days} DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS t1 FROM bars)"


def _touch(pt: float, sl: float) -> str:
    """CTEs ``touch`` from ``ev(code, t0, t1, trgt, side)``."""
    return f"""touch AS (
  SELECT e.code, e.t0, e.t1, e.trgt, e.side, min(p.ts) FILTER ((p.close / s.close - 1) * e.side > {pt} * e.trgt) AS pt,
    min(p.ts) FILTER ((p.close / s.close - 1) * e.side < -{sl} * e.trgt) AS sl
  FROM ev e JOIN bars s ON s.code = e.code AND s.ts = e.t0 LEFT JOIN bars p ON p.code = e.code AND p.ts >= e.t0 AND (p.ts <= e.t1 OR e.t1 IS NULL)
  GROUP BY ALL
), got AS MATERIALIZED (SELECT code, t0, least(t1, pt, sl) AS t1, trgt, side FROM touch)"""


_EV = f"""{_BASE}, {_VOL}, ev AS (
  SELECT c.code, c.t0, v1.t1, v.trgt, 1 AS side FROM cusum c JOIN vol v ON v.code = c.code AND v.ts = c.t0 JOIN {_vertical(DAYS)} v1 ON v1.code = c.code AND v1.t0 = c.t0
  WHERE v.trgt > {MIN_RET}
), {_touch(1, 1)}"""
_BINS = f"""{_EV}, bins AS (
  SELECT g.code, g.t0, g.t1, b.close / a.close - 1 AS ret, CAST(sign(b.close / a.close - 1) AS INTEGER) AS bin FROM got g
  JOIN bars a ON a.code = g.code AND a.ts = g.t0 JOIN bars b ON b.code = g.code AND b.ts = g.t1
)"""
_DROP = f"""{_BINS}, cnt AS (SELECT code, bin, count(*) AS n FROM bins GROUP BY ALL),
rank AS (SELECT *, sum(n) OVER (PARTITION BY code) AS total, count(*) OVER (PARTITION BY code) AS labels, row_number() OVER (PARTITION BY code ORDER BY n, bin) AS rn FROM cnt),
kept AS (SELECT b.* FROM bins b ANTI JOIN (SELECT code, bin FROM rank WHERE labels >= 3 AND rn = 1 AND n <= 0.3 * total) r USING (code, bin))"""
_CON = f"""{_EV}, con AS MATERIALIZED (
  SELECT b.code, b.ts, b.close, count(g.t0) AS c, any_value(ln(b.close) - ln(prev)) AS move
  FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY ts) AS prev FROM bars) b
  LEFT JOIN got g ON g.code = b.code AND b.ts >= g.t0 AND (b.ts <= g.t1 OR g.t1 IS NULL) GROUP BY b.code, b.ts, b.close
), uw AS (
  SELECT g.code, g.t0, avg(1 / c) AS tw, abs(sum(coalesce(move, 0) / c)) AS w FROM got g JOIN con b ON g.code = b.code AND b.ts >= g.t0 AND (b.ts <= g.t1 OR g.t1 IS NULL)
  GROUP BY g.code, g.t0
)"""
_IND = f"""{_EV}, pos AS (SELECT code, ts, row_number() OVER (PARTITION BY code ORDER BY ts) AS pos, count(*) OVER (PARTITION BY code) AS n FROM bars),
ind AS (SELECT g.code, g.t0, p.pos, p.n FROM got g JOIN pos p ON g.code = p.code AND p.ts >= g.t0 AND (p.ts <= g.t1 OR g.t1 IS NULL))"""


def _w_sql(thres: float) -> str:
    return str([round(w, 17) for w in reversed(D.weights_ffd(0.5, thres).tolist())])


_N = len(D.weights_ffd(0.5, 1e-3))
_FFD = f"""ffd AS (
  SELECT * FROM (SELECT code, ts, list(close) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW) AS x FROM bars) WHERE len(x) = {_N}
), fd AS (SELECT code, ts, list_dot_product(x, CAST({_w_sql(1e-3)} AS DOUBLE[])) AS fd_close FROM ffd)"""
_OBS = f"{_EV}, obs AS MATERIALIZED (SELECT code, t0, t1, row_number() OVER (ORDER BY t0, code) - 1 AS pos, ntile(5) OVER (ORDER BY t0, code) - 1 AS fold FROM got WHERE t1 IS NOT NULL)"
SQL = {
    "l1_asof": f"WITH {BARS_SQL}, {_VOL} SELECT code, ts, round(ret, 6) + 0.0 AS ret FROM ret",
    "l2_ewm": f"WITH {BARS_SQL}, {_VOL} SELECT code, ts, round(trgt, 6) + 0.0 AS trgt FROM vol",
    "l3_vertical": f"{_BASE} SELECT c.code, c.t0, v.t1 FROM cusum c JOIN {_vertical(DAYS)} v ON v.code = c.code AND v.t0 = c.t0",
    "l6_first_touch": f"""{_BASE}, ev AS (SELECT c.code, c.t0, v.t1, 0.01 AS trgt, 1 AS side FROM cusum c JOIN {_vertical(30)} v ON v.code = c.code AND v.t0 = c.t0),
        {_touch(1, 1)} SELECT code, t0, t1, pt, sl FROM touch""",
    "l7_events": f"{_EV} SELECT code, t0, t1 FROM got",
    "l8_bins": f"{_BINS} SELECT * REPLACE (round(ret, 6) + 0.0 AS ret) FROM bins",
    "l8_filled": f"""{_EV}, e AS (SELECT code, t0, CAST(t0 + INTERVAL 3 DAY AS DATE) AS t1 FROM got), nx AS (SELECT code, ts, close FROM bars),
        r AS (SELECT e.code, e.t0, e.t1, b.close / a.close - 1 AS ret FROM e ASOF LEFT JOIN nx a ON a.code = e.code AND e.t0 <= a.ts ASOF LEFT JOIN nx b ON b.code = e.code AND e.t1 <= b.ts)
        SELECT code, t0, t1, round(ret, 6) + 0.0 AS ret, CAST(sign(ret) AS INTEGER) AS bin FROM r WHERE ret IS NOT NULL""",
    "l8_meta_bins": f"""{_BASE}, {_VOL}, ev AS (
          SELECT c.code, c.t0, v1.t1, v.trgt, CASE WHEN b.close >= b.open THEN 1 ELSE -1 END AS side FROM cusum c JOIN vol v ON v.code = c.code AND v.ts = c.t0
          JOIN {_vertical(DAYS)} v1 ON v1.code = c.code AND v1.t0 = c.t0 JOIN bars b ON b.code = c.code AND b.ts = c.t0 WHERE v.trgt > {MIN_RET}
        ), {_touch(1, 2)}, r AS (SELECT g.code, g.t0, g.t1, (b.close / a.close - 1) * g.side AS ret FROM got g
          JOIN bars a ON a.code = g.code AND a.ts = g.t0 JOIN bars b ON b.code = g.code AND b.ts = g.t1)
        SELECT code, t0, t1, round(ret, 6) + 0.0 AS ret, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS bin FROM r""",
    "l9_drop": f"{_DROP} SELECT code, t0, bin FROM kept",
    "l10_label": f"{_DROP} SELECT code, t0, t1, round(ret, 6) + 0.0 AS ret, bin FROM kept",
    "w1_concurrency": f"{_CON} SELECT code, ts, c FROM con",
    "w2_uniqueness": f"{_CON} SELECT code, t0, round(tw, 6) + 0.0 AS tw FROM uw",
    "w3_return_w": f"{_CON} SELECT code, t0, round(w, 6) + 0.0 AS w FROM uw",
    "w4_norm": f"{_CON} SELECT code, t0, round(w * count(*) OVER (PARTITION BY code) / sum(w) OVER (PARTITION BY code), 6) + 0.0 AS w FROM uw",
    "w5_decay": f"""{_CON}, s AS (SELECT code, t0, sum(tw) OVER (PARTITION BY code ORDER BY t0) AS cum, sum(tw) OVER (PARTITION BY code) AS total FROM uw)
        SELECT code, t0, round(greatest(0, 1 - 0.5 + 0.5 / total * cum), 6) + 0.0 AS decay FROM s""",
    "w6_ind": f"{_IND} SELECT code, t0, CAST(pos AS BIGINT) AS pos FROM ind",
    "w7_avg_u": f"""{_IND}, c AS (SELECT code, pos, count(*) AS c FROM ind GROUP BY ALL)
        SELECT code, t0, round(sum(1 / (c + 0.001)) / any_value(n), 6) + 0.0 AS u FROM ind JOIN c USING (code, pos) GROUP BY code, t0""",
    "w10_fixed": f"{_BINS} SELECT code, t0, bin FROM bins WHERE day(t0) % 5 > 0",
    "f1_weights": """WITH RECURSIVE w AS (
          SELECT n_nationkey / 25 AS d, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS w FROM nation
          UNION ALL SELECT d, k + 1, -w / (k + 1) * (d - (k + 1) + 1) FROM w WHERE k < 5
        ) SELECT round(d, 6) + 0.0 AS d, k, round(w, 9) + 0.0 AS w FROM w""",
    "f3_ffd": f"WITH {BARS_SQL}, {_FFD} SELECT code, ts, round(fd_close, 6) + 0.0 AS fd_close FROM fd",
    "f4_frac": f"""WITH RECURSIVE {BARS_SQL}, num AS MATERIALIZED (SELECT code, ts, close, row_number() OVER (PARTITION BY code ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM bars),
        wt AS (SELECT CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w / (k + 1) * (0.5::DOUBLE - (k + 1) + 1) FROM wt WHERE k + 1 < (SELECT max(n) FROM num)),
        cw AS MATERIALIZED (SELECT k, w, sum(abs(w)) OVER (ORDER BY k) AS upto FROM wt),
        skip AS (SELECT s.code, count(*) FILTER (1 - (c.upto - abs(c.w)) / t.upto > 0.3) AS skip FROM (SELECT DISTINCT code, n FROM num) s JOIN cw t ON t.k = s.n - 1 JOIN cw c ON c.k < s.n GROUP BY s.code)
        SELECT a.code, a.ts, round(sum(w * b.close), 6) + 0.0 AS fd_close FROM num a JOIN skip USING (code) JOIN num b ON a.code = b.code AND b.i <= a.i JOIN cw ON k = a.i - b.i
        WHERE a.i >= skip GROUP BY a.code, a.ts""",
    "f5_sample": f"{_BINS}, {_FFD} SELECT b.code, b.t0, b.bin, round(fd_close, 6) + 0.0 AS fd_close FROM bins b JOIN fd ON fd.code = b.code AND fd.ts = b.t0",
    "c1_purge": f"{_OBS} SELECT code, t0, t1 FROM obs o WHERE NOT EXISTS (SELECT 1 FROM obs t WHERE t.code = 3 AND o.t0 <= t.t1 AND o.t1 >= t.t0)",
    "c2_embargo": f"""WITH {BARS_SQL}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM bars)),
        s AS (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) AS step, max(ts) AS last FROM t)
        SELECT t.ts, coalesce(u.ts, last) AS embargo FROM t CROSS JOIN s LEFT JOIN t u ON u.n = t.n + step""",
    "c3_kfold": f"{_OBS} SELECT code, t0, CAST(fold AS INTEGER) AS fold FROM obs",
    "c4_purged_kfold": f"""{_OBS}, f AS (SELECT fold, min(t0) AS b, max(t1) AS e, min(pos) AS lo, max(pos) AS hi FROM obs GROUP BY fold),
        g AS (SELECT f.*, (SELECT min(pos) FROM obs o WHERE o.t0 >= f.e) + (SELECT CAST(floor(count(*) * 0.01) AS BIGINT) FROM obs) AS resume FROM f),
        r AS (SELECT code, t0, g.fold, CASE WHEN pos BETWEEN lo AND hi THEN 'test' WHEN t1 <= b OR coalesce(pos >= resume, false) THEN 'train' END AS role FROM obs, g)
        SELECT code, t0, CAST(fold AS INTEGER) AS fold, role FROM r WHERE role IS NOT NULL""",
    "c6_describe": f"""{_BINS} SELECT count(ret) AS count, {", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in
        (("mean", "avg(ret)"), ("std", "stddev_samp(ret)"), ("min", "min(ret)"), ("q25", "quantile_cont(ret, 0.25)"), ("q50", "quantile_cont(ret, 0.5)"), ("q75", "quantile_cont(ret, 0.75)"), ("max", "max(ret)")))} FROM bins""",
    "c6_hist": f"""{_BINS}, e AS (SELECT min(bin) AS a, max(bin) AS b FROM bins)
        SELECT CAST(least(floor((bin - a) / (b - a) * 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM bins, e GROUP BY 1""",
}
