"""Queries of selection strategies, indicators and the supervised data set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import strategy as S
from ..sources.adapters import BARS_SQL, bars, table
from .common import longs, r6, rounded


def m1_top_return(spark, d):
    return rounded(S.top_return(bars(spark, d)), "rate")


def m2_ma(spark, d):
    return rounded(S.moving_average(bars(spark, d), (25,)).select("code", "ts", "ma_25"), "ma_25")


def m3_ma_rising(spark, d):
    return S.ma_rising(bars(spark, d), (25,)).where("rising").select("code", "window")


def m4_sweep(spark, d):
    return S.ma_rising(bars(spark, d))


def m5_low_cross(spark, d):
    return S.ma_low_cross(bars(spark, d))


def m6_rank(spark, d):
    return rounded(S.ma_ranking(bars(spark, d)), "rise")


def m7_small_peaks(spark, d):
    return S.small_peaks(bars(spark, d))


def m8_large_peaks(spark, d):
    return S.large_peaks(S.small_peaks(bars(spark, d)))


def m9_lines(spark, d):
    return rounded(S.candidate_lines(bars(spark, d), 20), "line_rate")


def m14_lines(spark, d):
    return rounded(S.trend_lines(bars(spark, d), 20, 3.0), "line_rate")


def m15_trend_line(spark, d):
    return rounded(S.pick_trend_line(S.trend_lines(bars(spark, d), 20, 3.0)), "line_rate")


def m16_result(spark, d):
    rows = bars(spark, d)
    picked = S.ma_ranking(rows).withColumn("method", F.concat(F.lit("ma_"), F.col("window").cast("string")))
    out = S.assemble_result(picked, rows)
    return out.select("method", F.array_join("result_code_list", ",").alias("codes"), "data_range_start_to_compute", "data_range_end_to_compute", "back_test_return_date")


def m17_line_sweep(spark, d):
    lines = S.trend_line_sweep(bars(spark, d), [(10, 2.0), (20, 3.0)])
    return lines.select("code", "length_limited", "rate", "start_idx", "end_idx", "touches")


def m18_user_strategy(spark, d):
    """A user's function: codes whose close rose over the last ten bars."""

    def rose(frame):
        frame = frame.sort_values("ts")
        gain = frame["close"].iloc[-1] / frame["close"].iloc[-min(10, len(frame))] - 1
        return frame.iloc[-1:][["code"]].assign(gain=gain).query("gain > 0")

    return rounded(S.run_strategy(bars(spark, d).select("code", "ts", "close"), rose, "code long, gain double"), "gain")


def i1_bbands(spark, d):
    rows = I.band_features(I.bollinger(bars(spark, d)))
    return rounded(rows.select("code", "ts", "upper", "lower", "x_width"), "upper", "lower", "x_width")


def i2_sma(spark, d):
    rows = I.sma_features(bars(spark, d))
    names = [c for c in rows.columns if "sma" in c]
    return rounded(rows.select("code", "ts", *names), *names)


def i3_mom(spark, d):
    return rounded(I.momentum(bars(spark, d)).select("code", "ts", "momentum"), "momentum")


def i4_label(spark, d):
    return I.forward_label(bars(spark, d)).select("code", "ts", "y")


def i5_calendar(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return longs(I.calendar_features(rows, "2024-01-03", "2024-01-10").drop("ts"), "day_of_week", "hour")


def i6_clean(spark, d):
    rows = I.clean_xy(I.momentum(I.forward_label(bars(spark, d))), ["y", "momentum"])
    return rows.groupBy("code").agg(F.count("*").alias("n"))


def _vectors(spark, d):
    names = [f"x{k}" for k in range(64)]
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)]), names


def i7_knn(spark, d):
    """Half of the vectors, drawn by the hash of their id, classify the other half."""
    rows, names = _vectors(spark, d)
    train = F.md5(F.col("vec_id").cast("string").cast("binary")) < "8"
    return I.knn_classify(rows.where(train), rows.where(~train), names, "label", "vec_id")


def i7_knn_search(spark, d):
    """Every 50th vector as a query against all other vectors, with all 64 columns."""
    rows, names = _vectors(spark, d)
    return I.knn_classify(rows, rows.where("vec_id % 50 = 0"), names, "label", "vec_id", leave_own=True)


def i8_split(spark, d):
    return I.split_by_time(bars(spark, d)).groupBy("code", "is_train").agg(F.count("*").alias("n"))


def d1_align(spark, d):
    rows = bars(spark, d).select("code", "ts", "open", "close")
    series = {f"c{k}": rows.where(F.col("code") == k).select("ts", "close") for k in (1, 2, 3)}
    return I.align_series(rows, series)


def d2_pct(spark, d):
    return rounded(I.pct_change(bars(spark, d)).select("code", "ts", "rate"), "rate")


def _classes(spark, d):
    return I.cut_classes(I.pct_change(bars(spark, d)))


def d3_cut(spark, d):
    return _classes(spark, d).select("code", "ts", "y")


def d4_logdiff(spark, d):
    return rounded(I.log_diff(bars(spark, d), ["close", "volume"]).select("code", "ts", "close", "volume"), "close", "volume")


def d5_counts(spark, d):
    return I.class_counts(_classes(spark, d))


def d6_sequences(spark, d):
    rows = I.sequences(_classes(spark, d), ["rate"], 5)
    rows = rows.select("code", "ts", "y", F.posexplode("steps").alias("step", "x"))
    return rows.select("code", "ts", "y", F.col("step").cast("long").alias("step"), r6("x.rate").alias("rate"))


def _predicted(spark, d):
    """The class of the bar before as a naive prediction."""
    before = F.lag("y").over(Window.partitionBy("code").orderBy("ts"))
    return _classes(spark, d).withColumn("p", before).where("p IS NOT NULL AND y IS NOT NULL")


def d7_confusion(spark, d):
    return I.confusion(_predicted(spark, d))


def d7_scores(spark, d):
    return rounded(I.precision_recall(_predicted(spark, d), key="code"), "precision", "recall", "f")


def d8_gate(spark, d):
    scores = I.precision_recall(_predicted(spark, d), positives=(1, 2, 3), key="code")
    p = F.array(*[F.col("tp") * ((F.col("code") + k) % 4) for k in range(4)])
    return I.selection_gate(scores.withColumn("probabilities", p)).select("code")


QUERIES = {
    f.__name__: f
    for f in (
        m1_top_return, m2_ma, m3_ma_rising, m4_sweep, m5_low_cross, m6_rank, m7_small_peaks, m8_large_peaks, m9_lines, m14_lines,
        m15_trend_line, m16_result, m17_line_sweep, m18_user_strategy, i1_bbands, i2_sma, i3_mom, i4_label, i5_calendar, i6_clean, i7_knn,
        i7_knn_search, i8_split, d1_align, d2_pct, d3_cut, d4_logdiff, d5_counts, d6_sequences, d7_confusion, d7_scores, d8_gate,
    )
}


def _knn(pairs: str) -> str:
    square = " + ".join(f"(a.x[{k}] - b.x[{k}]) * (a.x[{k}] - b.x[{k}])" for k in range(1, 65))
    return f"""WITH p AS (SELECT vec_id, label, [{", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(64))}] AS x FROM embeddings),
        q AS (SELECT a.vec_id AS row, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {square}, b.vec_id) AS rn FROM p a JOIN p b ON {pairs}),
        v AS (SELECT row, y, count(*) AS n FROM q WHERE rn <= 7 GROUP BY row, y)
        SELECT row, y AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC, y) = 1"""


def _ma(n: int) -> str:
    w = f"(PARTITION BY code ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {w} = {n} THEN avg(close) OVER {w} END"


def _averages(windows) -> str:
    return " UNION ALL ".join(f'SELECT code, ts, open, low, close, {n} AS "window", {_ma(n)} AS ma FROM bars' for n in windows)


def _ranked(windows) -> str:
    """CTE ``k``: per code and window whether the average rises and the low crosses it, and the rise."""
    return f"""WITH {BARS_SQL}, a AS ({_averages(windows)}), b AS (
  SELECT *, lag(ma) OVER w AS p_ma, lag(ma, 2) OVER w AS t_ma, lag(low) OVER w AS p_low,
    row_number() OVER (PARTITION BY code, "window" ORDER BY ts DESC) AS rn FROM a WINDOW w AS (PARTITION BY code, "window" ORDER BY ts)
), k AS (
  SELECT code, "window", bool_and(coalesce(ma - p_ma > 0, false)) AND count(*) = 3 AS rising,
    bool_or(rn <= 2 AND coalesce(p_low - p_ma <= 0, true) AND coalesce(low - ma > 0, false) AND close > open) AS crosses,
    max((ma - t_ma) / t_ma) FILTER (rn = 1) AS rise FROM b WHERE rn <= 3 GROUP BY code, "window"
)"""


_ALL = (75, 50, 25, 10)
_PLACE = 'row_number() OVER (PARTITION BY "window" ORDER BY rise DESC, code)'
_PEAKS = f"""WITH {BARS_SQL}, h AS (
  SELECT code, ts, high, row_number() OVER w - 1 AS idx, lead(high) OVER w AS nxt, lag(high) OVER w AS prv FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts)
), o AS (
  SELECT *, last_value(CASE WHEN prv <> high THEN prv END IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) AS other FROM h
), small AS (SELECT code, idx, ts, high AS price FROM o WHERE high > nxt AND other < high),
nb AS (SELECT *, lag(price) OVER w AS a, lead(price) OVER w AS b FROM small WINDOW w AS (PARTITION BY code ORDER BY idx)),
large AS (
  SELECT code, idx, ts, price, row_number() OVER (PARTITION BY code ORDER BY idx) - 1 AS peak FROM nb
  WHERE a IS NULL OR b IS NULL OR (a <= price AND price >= b)
)"""


def _lines(limit: int, rate: float, name: str = "") -> str:
    """CTEs ``cand<name>`` and ``line<name>``."""
    return f"""cand{name} AS (
  SELECT s.code, s.idx AS start_idx, e.idx AS end_idx, s.price AS start_price, e.price AS end_price, e.idx - s.idx AS length,
    e.peak - s.peak AS length_in_peaks, (e.price - s.price) / (e.idx - s.idx) AS line_rate
  FROM large s JOIN large e ON s.code = e.code AND s.idx < e.idx JOIN (SELECT code, count(*) AS n FROM bars GROUP BY code) c ON c.code = s.code
  WHERE n - e.idx <= {limit} AND (e.price - s.price) / (e.idx - s.idx) <= 0
), line{name} AS (
  SELECT c.*, bool_and(coalesce(h.high - (start_price + line_rate * (h.idx - start_idx)) < tol, true)) AS respected,
    count(*) FILTER (l.idx IS NOT NULL AND abs(h.high - (start_price + line_rate * (h.idx - start_idx))) < tol) AS touches
  FROM cand{name} c JOIN (SELECT code, trunc(max(high) - min(low)) * {rate} / 100 AS tol FROM bars GROUP BY code) t ON t.code = c.code
  LEFT JOIN h ON h.code = c.code AND h.idx > start_idx AND h.idx < end_idx LEFT JOIN large l ON l.code = h.code AND l.idx = h.idx
  GROUP BY ALL HAVING respected AND touches >= 1
)"""


_LINE_COLUMNS = """code, start_idx, end_idx, start_price, end_price, length, length_in_peaks, round(line_rate, 6) + 0.0 AS line_rate, touches,
  touches IN (1, 2) AND length + 1 >= 10 AS rule1, touches IN (1, 2) AS rule1_immediate, touches > 2 AS rule2"""
_Y = f"""WITH {BARS_SQL}, rt AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY code ORDER BY ts) - 1, 0) AS rate FROM bars),
y AS (SELECT *, CASE WHEN rate > -10 AND rate <= -0.01 THEN 0 WHEN rate > -0.01 AND rate <= 0 THEN 1 WHEN rate > 0 AND rate <= 0.01 THEN 2
  WHEN rate > 0.01 AND rate <= 10 THEN 3 END AS y FROM rt)"""
_P = f"{_Y}, p AS (SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY code ORDER BY ts) AS p FROM y) WHERE p IS NOT NULL AND y IS NOT NULL)"


def _prf(positives: str) -> str:
    return f"""{_P}, c AS (
  SELECT code, count(*) FILTER (y IN {positives} AND p IN {positives}) AS tp, count(*) FILTER (y NOT IN {positives} AND p IN {positives}) AS fp,
    count(*) FILTER (y IN {positives} AND p NOT IN {positives}) AS fn FROM p GROUP BY code
), s AS (SELECT *, tp / (tp + fp + 1e-7) AS "precision", tp / (tp + fn + 1e-7) AS recall FROM c),
f AS (SELECT *, 2 * "precision" * recall / ("precision" + recall + 1e-7) AS f FROM s)"""


_W20 = "(PARTITION BY code ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_SMA = {n: _ma(n) for n in (10, 20, 50, 100)}
SQL = {
    "m1_top_return": f"""WITH {BARS_SQL}, l AS (SELECT *, lag(close) OVER w AS prev, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS rn FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts))
        SELECT code, round((close - prev) / prev, 6) + 0.0 AS rate FROM l WHERE rn = 1 AND prev IS NOT NULL ORDER BY (close - prev) / prev DESC, code LIMIT 1""",
    "m2_ma": f"WITH {BARS_SQL} SELECT code, ts, round({_ma(25)}, 6) + 0.0 AS ma_25 FROM bars",
    "m3_ma_rising": f'{_ranked((25,))} SELECT code, "window" FROM k WHERE rising',
    "m4_sweep": f'{_ranked(_ALL)} SELECT code, "window", rising FROM k',
    "m5_low_cross": f'{_ranked(_ALL)} SELECT code, "window", crosses FROM k',
    "m6_rank": f'{_ranked(_ALL)} SELECT code, "window", round(rise, 6) + 0.0 AS rise, {_PLACE} AS place FROM k WHERE rising AND crosses',
    "m7_small_peaks": f"{_PEAKS} SELECT * FROM small",
    "m8_large_peaks": f"{_PEAKS} SELECT * FROM large",
    "m9_lines": f"{_PEAKS}, {_lines(20, 3.0)} SELECT * REPLACE (round(line_rate, 6) + 0.0 AS line_rate) FROM cand",
    "m14_lines": f"{_PEAKS}, {_lines(20, 3.0)} SELECT {_LINE_COLUMNS} FROM line",
    "m15_trend_line": f"{_PEAKS}, {_lines(20, 3.0)} SELECT {_LINE_COLUMNS} FROM line QUALIFY row_number() OVER (PARTITION BY code ORDER BY end_idx DESC, start_idx DESC) = 1",
    "m16_result": f"""{_ranked(_ALL)}, x AS (SELECT *, {_PLACE} AS place FROM k WHERE rising AND crosses)
        SELECT 'ma_' || "window" AS method, string_agg(CAST(code AS VARCHAR), ',' ORDER BY place) AS codes, (SELECT min(ts) FROM bars) AS data_range_start_to_compute,
        (SELECT max(ts) FROM bars) AS data_range_end_to_compute, 0 AS back_test_return_date FROM x GROUP BY "window" """,
    "m17_line_sweep": f"""{_PEAKS}, {_lines(10, 2.0, "1")}, {_lines(20, 3.0, "2")}
        SELECT code, 10 AS length_limited, CAST(2 AS DOUBLE) AS rate, start_idx, end_idx, touches FROM line1
        UNION ALL SELECT code, 20, CAST(3 AS DOUBLE), start_idx, end_idx, touches FROM line2""",
    "m18_user_strategy": f"""WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS rn FROM bars),
        g AS (SELECT code, min_by(close, rn) / max_by(close, rn) - 1 AS gain FROM n WHERE rn <= 10 GROUP BY code)
        SELECT code, round(gain, 6) + 0.0 AS gain FROM g WHERE gain > 0""",
    "i1_bbands": f"""WITH {BARS_SQL}, x AS (SELECT code, ts, close, (high + low + close) / 3 AS t FROM bars),
        m AS (SELECT *, count(*) OVER {_W20} AS n, avg(t) OVER {_W20} AS mu, stddev_samp(t) OVER {_W20} AS sd FROM x),
        b AS (SELECT code, ts, close, CASE WHEN n = 20 THEN mu + 2 * sd END AS u, CASE WHEN n = 20 THEN mu - 2 * sd END AS l FROM m)
        SELECT code, ts, round(u, 6) + 0.0 AS upper, round(l, 6) + 0.0 AS lower, round((u - l) / close, 6) + 0.0 AS x_width FROM b""",
    "i2_sma": f"""WITH {BARS_SQL}, m AS (SELECT code, ts, close, {", ".join(f"{s} AS m{n}" for n, s in _SMA.items())} FROM bars)
        SELECT code, ts, {", ".join(f"round((close - m{n}) / close, 6) + 0.0 AS x_sma_{n}" for n in _SMA)},
        {", ".join(f"round((m{a} - m{b}) / close, 6) + 0.0 AS d_sma_{a}_{b}" for a, b in ((10, 20), (20, 50), (50, 100)))} FROM m""",
    "i3_mom": f"WITH {BARS_SQL} SELECT code, ts, round(close / lag(close, 2) OVER (PARTITION BY code ORDER BY ts) - 1, 6) + 0.0 AS momentum FROM bars",
    "i4_label": f"""WITH {BARS_SQL}, r AS (SELECT code, ts, lead(close, 48) OVER (PARTITION BY code ORDER BY ts) / close - 1 AS r FROM bars)
        SELECT code, ts, CAST(CASE WHEN abs(r) <= 0.004 THEN 0 ELSE sign(r) END AS INTEGER) AS y FROM r""",
    "i5_calendar": """SELECT event_id, NOT (ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10') AS outside,
        CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(hour(ts) AS BIGINT) AS hour FROM events""",
    "i6_clean": f"""WITH {BARS_SQL}, r AS (SELECT code, lead(close, 48) OVER w AS a, lag(close, 2) OVER w AS b FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts))
        SELECT code, count(*) AS n FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY code""",
    "i7_knn": _knn("md5(CAST(a.vec_id AS VARCHAR)) >= '8' AND md5(CAST(b.vec_id AS VARCHAR)) < '8'"),
    "i7_knn_search": _knn("a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id"),
    "i8_split": f"""WITH {BARS_SQL}, n AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY ts) <= CAST(floor(count(*) OVER (PARTITION BY code) * 0.8) AS BIGINT) AS is_train FROM bars)
        SELECT code, is_train, count(*) AS n FROM n GROUP BY ALL""",
    "d1_align": f"""WITH {BARS_SQL} SELECT b.code, ts, b.open, b.close, c1, c2, c3 FROM bars b
        {" ".join(f"JOIN (SELECT ts, close AS c{k} FROM bars WHERE code = {k}) s{k} USING (ts)" for k in (1, 2, 3))}""",
    "d2_pct": f"{_Y} SELECT code, ts, round(rate, 6) + 0.0 AS rate FROM rt",
    "d3_cut": f"{_Y} SELECT code, ts, y FROM y",
    "d4_logdiff": f"""WITH {BARS_SQL}, l AS (SELECT code, ts, row_number() OVER w AS rn, log10(close) - lag(log10(close)) OVER w AS c, log10(volume) - lag(log10(volume)) OVER w AS v
        FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts)) SELECT code, ts, round(c, 6) + 0.0 AS close, round(v, 6) + 0.0 AS volume FROM l WHERE rn > 1""",
    "d5_counts": f"{_Y} SELECT code, y, count(*) AS n FROM y GROUP BY ALL",
    "d6_sequences": f"""{_Y}, n AS (SELECT code, ts, y, row_number() OVER w AS rn, [{", ".join(f"lag(rate, {5 - k}) OVER w" for k in range(5))}] AS steps
          FROM y WINDOW w AS (PARTITION BY code ORDER BY ts)), u AS (SELECT code, ts, y, unnest(range(5)) AS step, steps FROM n WHERE rn > 5)
        SELECT code, ts, y, step, round(steps[step + 1], 6) + 0.0 AS rate FROM u""",
    "d7_confusion": f"{_P} SELECT y, {', '.join(f'count(*) FILTER (p = {k}) AS p_{k}' for k in range(4))} FROM p GROUP BY y",
    "d7_scores": f"""{_prf("(2, 3)")} SELECT code, tp, fp, fn, round("precision", 6) + 0.0 AS "precision", round(recall, 6) + 0.0 AS recall, round(f, 6) + 0.0 AS f FROM f""",
    "d8_gate": f"""{_prf("(1, 2, 3)")}, g AS (SELECT *, [tp * ((code + 0) % 4), tp * ((code + 1) % 4), tp * ((code + 2) % 4), tp * ((code + 3) % 4)] AS p FROM f)
        SELECT code FROM g WHERE f > 0.65 AND "precision" > 0.6 AND list_position(p, list_max(p)) - 1 IN (2, 3)""",
}
