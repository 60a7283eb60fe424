"""Queries of bets, back-test statistics, rewards and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import betting as B
from ..operators import reward as Q
from ..operators import scoring as N
from ..operators import stats as R
from ..operators.bars import cusum_events
from ..sources.adapters import BARS_SQL, bars, table
from .common import longs, r6, rounded
from .source_queries import cusum_sql


def _bets(spark, d):
    """Each bar as a prediction: its place in the day's range as probability, its direction as label, valid for three bars."""
    prob = 0.05 + 0.9 * (F.col("close") - F.col("low") + 1) / (F.col("high") - F.col("low") + 2)
    end = F.lead("ts", 3).over(Window.partitionBy("code").orderBy("ts"))
    pred = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    return bars(spark, d).select("code", F.col("ts").alias("t0"), end.alias("t1"), prob.alias("prob"), pred.alias("pred"))


def b1_signal(spark, d):
    return rounded(B.bet_signal(_bets(spark, d), 2).select("code", "t0", "signal"), "signal")


def b2_active(spark, d):
    return rounded(B.avg_active(B.bet_signal(_bets(spark, d), 2)), "signal")


def b3_discrete(spark, d):
    return rounded(B.bet_signal(_bets(spark, d), 2, step=0.1).select("code", "t0", "signal"), "signal")


def _forecasts(spark, d):
    """Forecast: the day's open; market price: its close; position from the volume."""
    rows = bars(spark, d).withColumns({"w": F.lit(25.0), "most": F.lit(10)})
    return rows.withColumn("position", F.pmod(F.col("volume"), F.lit(5)).cast("int"))


def b4_size(spark, d):
    target = B.target_position(F.col("w"), F.col("open"), F.col("close"), F.col("most"))
    size = B.bet_size(F.col("open") - F.col("close"), F.col("w"))
    inverse = B.inverse_price(F.col("open"), F.col("w"), F.lit(0.5))
    rows = _forecasts(spark, d).select("code", "ts", size.alias("size"), target.alias("target"), inverse.alias("price"), B.calibrate_w(F.col("volume"), F.lit(0.95)).alias("cal_w"))
    return rounded(rows, "size", "price", "cal_w")


def b5_limit(spark, d):
    target = B.target_position(F.col("w"), F.col("open") + 30, F.col("close"), F.col("most"))
    price = B.limit_price(F.col("target"), F.col("position"), F.col("open") + 30, F.col("w"), F.col("most") + 1)
    return rounded(_forecasts(spark, d).withColumn("target", target).select("code", "ts", "target", price.alias("price")), "price")


def _positions(spark, d):
    return bars(spark, d).select("code", "ts", (F.pmod(F.col("volume"), F.lit(3)) - 1).cast("int").alias("pos"))


def r1_bets(spark, d):
    return R.bet_times(_positions(spark, d))


def r2_holding(spark, d):
    return rounded(R.holding_period(_positions(spark, d)), "days")


def _returns(spark, d):
    move = F.col("close") - F.lag("close").over(Window.partitionBy("code").orderBy("ts"))
    return bars(spark, d).select("code", "ts", move.alias("ret")).where("ret > 0")


def r3_hhi(spark, d):
    return rounded(R.hhi(_returns(spark, d)), "hhi")


def r4_drawdown(spark, d):
    return rounded(R.drawdown(bars(spark, d).select("code", "ts", F.col("close").alias("pnl"))), "dd", "tuw")


def _signals(spark, d):
    return bars(spark, d).select("code", "ts", "open", "close", F.signum(F.col("close") - F.col("open")).cast("int").alias("signal"))


def r5_trades(spark, d):
    return rounded(longs(R.flip_trades(_signals(spark, d)), "size"), "ret")


def r6_returns(spark, d):
    equity = bars(spark, d).select("code", "ts", (F.col("close") * 100).alias("equity"))
    return R.equity_returns(equity).select("code", "ts", "ret")


def r7_twrr(spark, d):
    return rounded(R.twrr(R.flip_trades(_signals(spark, d))), "twrr")


def r7_recurrence(spark, d):
    return rounded(R.twrr(R.flip_trades(_signals(spark, d)), "recurrence"), "twrr")


def r8_rule_grid(spark, d):
    rows = bars(spark, d)
    grid = [(float(a), float(b)) for a in (5, 10, 20) for b in (5, 10, 20)]
    return rounded(R.rule_grid(cusum_events(rows, 30.0), rows, grid, 10), "mean", "std", "sharpe")


def _selection(spark, d):
    codes = bars(spark, d).select("code").distinct()
    return codes.select(F.concat(F.lit("m"), (F.col("code") % 3).cast("string")).alias("method"), "code", F.lit("1997-06-01").alias("data_range_end"))


def q1_reward(spark, d):
    rows = Q.reward(_selection(spark, d), bars(spark, d), 5)
    return rows.select("method", "code", r6("reward_rate_mean").alias("reward_rate_mean"), r6(F.get("reward_rates", F.lit(4))).alias("fifth"))


def q1_later(spark, d):
    rows = Q.reward(_selection(spark, d), bars(spark, d), -1)
    return rows.select("method", "code", r6("reward_rate_mean").alias("reward_rate_mean"), F.size("reward_rates").cast("long").alias("n"))


def q2_summary(spark, d):
    return rounded(Q.reward_summary(Q.reward(_selection(spark, d), bars(spark, d), 5)), "reward_rate_mean_in_method")


def _ranked(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.get("embedding", F.lit(0)).cast("double").alias("pred"), F.col("label").alias("target"))
    return N.pct_rank_first(rows)


def n1_pctrank(spark, d):
    return rounded(_ranked(spark, d).select("row", "rank"), "rank")


def n2_corr(spark, d):
    return rounded(N.score_corr(_ranked(spark, d)), "score")


def n3_means(spark, d):
    names = [f"feature_{N.GROUPS[k % 6]}{k}" for k in range(64)]
    wide = table(spark, d, "embeddings").select(*[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(names)])
    return rounded(N.column_means(wide, N.feature_columns(wide)), "mean")


QUERIES = {
    f.__name__: f
    for f in (
        b1_signal, b2_active, b3_discrete, b4_size, b5_limit, r1_bets, r2_holding, r3_hhi, r4_drawdown, r5_trades, r6_returns, r7_twrr,
        r7_recurrence, r8_rule_grid, q1_reward, q1_later, q2_summary, n1_pctrank, n2_corr, n3_means,
    )
}

_SIGNAL = f"""WITH {BARS_SQL}, bet AS (
  SELECT code, ts AS t0, lead(ts, 3) OVER (PARTITION BY code ORDER BY ts) AS t1, 0.05 + 0.9 * (close - low + 1) / (high - low + 2) AS p, CASE WHEN close >= open THEN 1 ELSE -1 END AS pred FROM bars
), z AS (SELECT *, (p - 1.0 / 2) / sqrt(p * (1 - p)) AS z FROM bet),
u AS (SELECT *, abs(z) / sqrt(2.0) AS a, 1 / (1 + CAST(0.3275911 AS DOUBLE) * (abs(z) / sqrt(2.0))) AS t FROM z),
e AS (SELECT *, 1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-a * a) AS erf FROM u),
sig AS (SELECT code, t0, t1, pred * (2 * (CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END) - 1) AS s FROM e)"""
_SIZE = f"WITH {BARS_SQL}, f AS (SELECT code, ts, open, close, volume, CAST(volume % 5 AS INTEGER) AS position FROM bars)"
_POS = f"WITH RECURSIVE {BARS_SQL}, pos AS MATERIALIZED (SELECT code, ts, CAST(volume % 3 AS INTEGER) - 1 AS pos, row_number() OVER (PARTITION BY code ORDER BY ts) AS rn, min(ts) OVER (PARTITION BY code) AS t0 FROM bars)"
_TRADES = f"""WITH RECURSIVE {BARS_SQL}, s AS (
  SELECT *, last_value(nullif(sign(close - open), 0) IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) AS side, lead(open) OVER w AS no, lead(ts) OVER w AS nt,
    max(ts) OVER (PARTITION BY code) AS fts FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts)
), t AS (SELECT *, lag(side) OVER (PARTITION BY code ORDER BY ts) AS was, max(CASE WHEN ts = fts THEN close END) OVER (PARTITION BY code) AS fin FROM s),
u AS (
  SELECT code, row_number() OVER w AS trade_id, nt AS entry_ts, coalesce(lead(nt) OVER w, fts) AS exit_ts, no AS entry_price, coalesce(lead(no) OVER w, fin) AS exit_price, side
  FROM t WHERE side IS NOT NULL AND (was IS NULL OR was <> side) AND no IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY ts)
), trades AS MATERIALIZED (SELECT *, (exit_price - entry_price) / entry_price * side AS r FROM u)"""
_RW = f"""WITH {BARS_SQL}, s AS (SELECT 'm' || (code % 3) AS method, code, ts, close, row_number() OVER w AS rn, first_value(close) OVER w AS buy
  FROM bars WHERE ts >= DATE '1997-06-01' WINDOW w AS (PARTITION BY code ORDER BY ts)),
x AS (SELECT *, (close - buy) / buy AS rate FROM s)"""
_RANK = "WITH r AS (SELECT vec_id AS row, label AS target, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) / count(*) OVER () AS rank FROM embeddings)"
_NAMES = [f"feature_{N.GROUPS[k % 6]}{k}" for k in range(64)]
SQL = {
    "b1_signal": f"{_SIGNAL} SELECT code, t0, round(s, 6) + 0.0 AS signal FROM sig",
    "b2_active": f"""{_SIGNAL}, d AS (SELECT code, t0 AS t, s, 1 AS n FROM sig UNION ALL SELECT code, t1, -s, -1 FROM sig WHERE t1 IS NOT NULL),
        a AS (SELECT code, t, sum(s) AS s, sum(n) AS n FROM d GROUP BY ALL),
        c AS (SELECT code, t, sum(s) OVER w AS s, sum(n) OVER w AS n FROM a WINDOW w AS (PARTITION BY code ORDER BY t))
        SELECT code, t, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 6) + 0.0 AS signal FROM c""",
    "b3_discrete": f"{_SIGNAL} SELECT code, t0, round(least(1, greatest(-1, round_even(s / 0.1::DOUBLE, 0) * 0.1::DOUBLE)), 6) + 0.0 AS signal FROM sig",
    "b4_size": f"""{_SIZE} SELECT code, ts, round((open - close) / sqrt(25 + pow(open - close, 2)), 6) + 0.0 AS size,
        CAST(trunc((open - close) / sqrt(25 + pow(open - close, 2)) * 10) AS INTEGER) AS target, round(open - 0.5 * sqrt(25 / 0.75), 6) + 0.0 AS price,
        round(volume * volume * (1 / (0.95::DOUBLE * 0.95::DOUBLE) - 1), 6) + 0.0 AS cal_w FROM f""",
    "b5_limit": f"""{_SIZE}, t AS (SELECT *, CAST(trunc((open + 30 - close) / sqrt(25 + pow(open + 30 - close, 2)) * 10) AS INTEGER) AS target FROM f),
        k AS (SELECT *, CAST(abs(position + sign(target - position)) AS INTEGER) AS lo, abs(target) AS hi FROM t),
        p AS (SELECT *, CASE WHEN lo <= hi THEN list_sum(list_transform(range(lo, hi + 1), lambda j: open + 30 - (j / 11) * sqrt(25 / (1 - (j / 11) * (j / 11))))) END AS total FROM k)
        SELECT code, ts, target, round(CASE WHEN target <> position AND lo <= hi THEN total / (target - position) END, 6) + 0.0 AS price FROM p""",
    "r1_bets": f"""{_POS}, x AS (SELECT *, lag(pos) OVER w AS prev, lead(ts) OVER w AS nxt FROM pos WINDOW w AS (PARTITION BY code ORDER BY ts))
        SELECT code, ts FROM x WHERE (pos = 0 AND prev <> 0) OR pos * prev < 0 OR nxt IS NULL""",
    "r2_holding": f"""{_POS}, walk AS (
          SELECT code, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS num, CAST(0 AS DOUBLE) AS den FROM (SELECT DISTINCT code FROM pos)
          UNION ALL
          SELECT x.code, x.rn, x.pos, CASE WHEN (x.pos - p) * p >= 0 THEN CASE WHEN x.pos <> 0 THEN (entry * p + day * (x.pos - p)) / x.pos ELSE entry END WHEN x.pos * p < 0 THEN day ELSE entry END,
            num + (day - entry) * amount, den + amount
          FROM (SELECT w.p, w.entry, w.num, w.den, n.code, n.rn, CAST(n.pos AS DOUBLE) AS pos, CAST(date_diff('day', n.t0, n.ts) AS DOUBLE) AS day,
                  CASE WHEN (n.pos - p) * p >= 0 THEN 0 WHEN n.pos * p < 0 THEN abs(p) ELSE abs(n.pos - p) END AS amount
                FROM walk w JOIN pos n ON n.code = w.code AND n.rn = w.rn + 1) x
        ) SELECT code, round(max_by(num, rn) / nullif(max_by(den, rn), 0), 6) + 0.0 AS days FROM walk GROUP BY code""",
    "r3_hhi": f"""WITH {BARS_SQL}, m AS (SELECT code, close - lag(close) OVER (PARTITION BY code ORDER BY ts) AS r FROM bars),
        g AS (SELECT code, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM m WHERE r > 0 GROUP BY code)
        SELECT code, CASE WHEN n > 2 THEN round((q / (s * s) - 1 / n) / (1 - 1 / n), 6) + 0.0 END AS hhi FROM g""",
    "r4_drawdown": f"""WITH {BARS_SQL}, h AS (SELECT code, ts, close, max(close) OVER (PARTITION BY code ORDER BY ts) AS hwm FROM bars),
        g AS (SELECT code, hwm, min(close) AS low, min(ts) AS ts FROM h GROUP BY code, hwm HAVING hwm > min(close))
        SELECT code, hwm, ts, round(1 - low / hwm, 6) + 0.0 AS dd, round(date_diff('day', ts, lead(ts) OVER (PARTITION BY code ORDER BY ts)) / 365.2425::DOUBLE, 6) + 0.0 AS tuw FROM g""",
    "r5_trades": f"""{_TRADES} SELECT code, trade_id, entry_ts, exit_ts, entry_price, exit_price, CAST(floor(100000 / entry_price) * side AS BIGINT) AS size,
        round(r - 0.001::DOUBLE * (1 + exit_price / entry_price), 6) + 0.0 AS ret FROM trades""",
    "r6_returns": f"WITH {BARS_SQL} SELECT code, ts, close * 100 - lag(close * 100) OVER (PARTITION BY code ORDER BY ts) AS ret FROM bars",
    "r7_twrr": f"{_TRADES} SELECT code, round(product(1 + r) - 1, 6) + 0.0 AS twrr FROM trades GROUP BY code",
    "r7_recurrence": f"""{_TRADES}, walk AS (
          SELECT code, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS x FROM (SELECT DISTINCT code FROM trades)
          UNION ALL SELECT w.code, w.k + 1, x * (1 + r) - 1 FROM walk w JOIN trades t ON t.code = w.code AND t.trade_id = w.k + 1
        ) SELECT code, round(max_by(x, k), 6) + 0.0 AS twrr FROM walk GROUP BY code""",
    "r8_rule_grid": f"""WITH RECURSIVE {BARS_SQL}, {cusum_sql(30)}, rule AS (SELECT CAST(a AS DOUBLE) AS pt, CAST(b AS DOUBLE) AS sl FROM (SELECT unnest([5, 10, 20]) AS a), (SELECT unnest([5, 10, 20]) AS b)),
        step AS (SELECT c.code, c.t0, b.rn - a.rn AS k, b.close - a.close AS m FROM cusum c JOIN num a ON a.code = c.code AND a.ts = c.t0 JOIN num b ON b.code = c.code AND b.rn BETWEEN a.rn + 1 AND a.rn + 10),
        g AS (SELECT pt, sl, code, t0, coalesce(min_by(m, k) FILTER (m > pt OR m < -sl), max_by(m, k)) AS gain FROM step, rule GROUP BY ALL)
        SELECT pt, sl, round(avg(gain), 6) + 0.0 AS mean, round(stddev_pop(gain), 6) + 0.0 AS std, count(*) AS paths, round(avg(gain) / nullif(stddev_pop(gain), 0), 6) + 0.0 AS sharpe FROM g GROUP BY pt, sl""",
    "q1_reward": f"{_RW} SELECT method, code, round(avg(rate), 6) + 0.0 AS reward_rate_mean, round(max(rate) FILTER (rn = 5), 6) + 0.0 AS fifth FROM x WHERE rn <= 5 GROUP BY method, code",
    "q1_later": f"{_RW} SELECT method, code, round(avg(rate) FILTER (ts > DATE '1997-06-01'), 6) + 0.0 AS reward_rate_mean, count(*) FILTER (ts > DATE '1997-06-01') AS n FROM x GROUP BY method, code",
    "q2_summary": f"""{_RW}, m AS (SELECT method, code, avg(rate) AS a FROM x WHERE rn <= 5 GROUP BY method, code)
        SELECT method, round(avg(a), 6) + 0.0 AS reward_rate_mean_in_method, count(*) FILTER (a > 0) || ' / ' || count(*) AS count_winner_brand FROM m GROUP BY method""",
    "n1_pctrank": f"{_RANK} SELECT row, round(rank, 6) + 0.0 AS rank FROM r",
    "n2_corr": f"{_RANK} SELECT round(corr(target, rank), 6) + 0.0 AS score FROM r",
    "n3_means": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST(embedding[{k + 1}] AS DOUBLE)), 6) + 0.0 AS mean FROM embeddings" for k, c in enumerate(_NAMES)),
}
