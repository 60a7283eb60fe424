"""Queries of sources, cleaning, trades and bars."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import clean as C
from ..sources.adapters import BARS_SQL, TICKS_SQL, bars, table, ticks
from .common import r6, rounded


def s2_holdout(spark, d):
    return C.holdout(bars(spark, d), 5).select("code", "ts", "close")


def s3_span(spark, d):
    return C.date_span(bars(spark, d), end="1997-06-30", periods=2, freq="M").select("code", "ts", "close")


def s7_listing(spark, d):
    return C.listing_filter(table(spark, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


def s8_universe(spark, d):
    universe = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"))
    return C.restrict(bars(spark, d), universe).select("code", "ts", "close")


def s9_html_codes(spark, d):
    return C.html_values(table(spark, d, "pages"), '<a href="/([A-Za-z]+)"')


def s10_hrefs(spark, d):
    return C.html_attribute(table(spark, d, "pages"), "a", "href", "th", "https://site.test")


def s11_html_table(spark, d):
    """Price tables written as HTML from the bars, and read again."""
    cell = F.concat(
        F.lit("<tr><td>"), F.date_format("ts", "yyyy-MM-dd"), F.lit("</td><td>"), F.format_number("close", 0), F.lit("</td></tr>")
    )
    rows = bars(spark, d).groupBy(F.col("code").alias("page_id")).agg(F.array_join(F.collect_list(cell), "").alias("rows"))
    head = '<html><table class="x"><tr><td>1</td></tr></table><table data-test="historical-prices"><tr><th>Date</th><th>Adj Close**</th></tr>'
    pages = rows.select("page_id", F.concat(F.lit(head), "rows", F.lit("<tr><td>*note</td></tr></table></html>")).alias("html"))
    return C.html_table(pages, ["Date", "Adj_Close"])


def s12_clean(spark, d):
    text = F.when(F.col("volume") % 3 == 0, "-").otherwise(F.col("close").cast("long").cast("string"))
    rows = bars(spark, d).select(F.col("code").alias("name"), F.date_format("ts", "MMM d, yyyy").alias("date"), text.alias("close"))
    return C.clean_scraped(rows, ["close"])


def s13_backfill(spark, d):
    gap = F.when(F.col("volume") % 2 == 0, F.col("close"))
    return C.backfill(bars(spark, d).select(F.col("code").alias("name"), "ts", gap.alias("close")), ["close"])


def s14_unpivot(spark, d):
    return C.to_series(bars(spark, d).select("code", "ts", "open", "high", "low", "close"), ["code", "ts"], ["open", "high", "low", "close"])


def s15_candles(spark, d):
    mid = F.struct(*[F.col(c).cast("long").cast("string").alias(c[0]) for c in ("open", "high", "low", "close")])
    entry = F.struct(F.concat(F.col("ts").cast("string"), F.lit("T00:00:00Z")).alias("time"), mid.alias("mid"))
    documents = bars(spark, d).groupBy("code").agg(F.to_json(F.struct(F.collect_list(entry).alias("candles"))).alias("json"))
    return C.flatten_candles(documents, end="1997-12-31")


def s16_epoch(spark, d):
    rows = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"))
    return C.epoch_to_timestamp(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _results(spark, d):
    """A selection result per nation: its suppliers."""
    return table(spark, d, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("method")).agg(
        F.sort_array(F.collect_list(F.col("s_suppkey").cast("string"))).alias("result_code_list"),
        F.lit("2020-01-01").alias("creat_time"),
        F.lit("1992-01-01").alias("data_range_start_to_compute"),
        F.lit("1998-01-01").alias("data_range_end_to_compute"),
    )


def s18_flatten(spark, d):
    return C.flatten_selection(_results(spark, d), "https://charts.test/")


def s19_latest(spark, d):
    file = F.concat("o_orderpriority", F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), file.alias("file"), "o_custkey")
    return C.latest_per_method(rows)


def s20_documents(spark, d):
    rates = bars(spark, d).groupBy("code").agg(r6(F.avg(F.col("close") / F.col("open") - 1)).alias("reward_rate_mean"))
    rows = rates.select(F.concat(F.lit("m"), (F.col("code") % 5).cast("string")).alias("method"), "code", F.array("reward_rate_mean").alias("reward_rates"), "reward_rate_mean")
    return C.reward_documents(rows).select("method", F.explode("reward_results").alias("x")).select("method", "x.code", "x.reward_rate_mean")


def s22_head(spark, d):
    return C.head_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100)


def p2_trades(spark, d):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'D'HH:mm:ss.SSSSSS")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.concat(text, F.lit("789")).alias("timestamp"))
    return B.parse_trades(rows, "click").select("event_id", F.col("time").cast("timestamp_ntz").alias("time"))


def p3_candles(spark, d):
    return B.make_candles(ticks(spark, d, "event_type"), "click")


def t1_vwap(spark, d):
    return rounded(B.vwap(ticks(spark, d)), "vwap")


def t2_dollar_bars(spark, d):
    return rounded(B.dollar_bars(ticks(spark, d), 20_000.0), "dollars")


def t1_trades(spark, d):
    """Every trade beside its symbol's mean price."""
    return rounded(B.with_vwap(ticks(spark, d)).select("symbol", "seq", "price", "vwap"), "vwap")


def t2_daily(spark, d):
    """Bars of each event type that begin anew every day."""
    return rounded(B.dollar_bars(ticks(spark, d, "event_type"), 20_000.0, "daily"), "dollars")


def t2_cumulative(spark, d):
    return rounded(B.dollar_bars(ticks(spark, d), 20_000.0, "cumulative"), "dollars")


def _instruments(spark, d):
    return bars(spark, d).withColumn("instrument", F.date_format("ts", "yyyyMM"))


def t3_roll_gaps(spark, d):
    return B.roll_gaps(_instruments(spark, d)).select("code", "ts", "gap")


def t4_rolled(spark, d):
    return B.rolled_series(_instruments(spark, d)).select("code", "ts", "close")


def t5_cusum(spark, d):
    return B.cusum_events(bars(spark, d), 30.0)


def t5_cusum_long(spark, d):
    return B.cusum_events(bars(spark, d), 20.0)


_NEXT = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def cusum_sql(h: float) -> str:
    """CTEs down to ``cusum(code, t0)``; put after ``WITH RECURSIVE`` and the bars."""
    return f"""
num AS MATERIALIZED (SELECT code, ts, close, row_number() OVER (PARTITION BY code ORDER BY ts) AS rn FROM bars),
walk AS (
  SELECT code, rn, ts, close, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, false AS hit FROM num WHERE rn = 1
  UNION ALL
  SELECT code, rn, ts, close, CASE WHEN NOT b < -{h} AND a > {h} THEN 0 ELSE a END, CASE WHEN b < -{h} THEN 0 ELSE b END, b < -{h} OR a > {h}
  FROM (SELECT n.*, greatest(0, up + n.close - w.close) AS a, least(0, down + n.close - w.close) AS b
        FROM walk w JOIN num n ON n.code = w.code AND n.rn = w.rn + 1)
), cusum AS (SELECT code, ts AS t0 FROM walk WHERE hit)"""


QUERIES = {
    f.__name__: f
    for f in (
        s2_holdout, s3_span, s7_listing, s8_universe, s9_html_codes, s10_hrefs, s11_html_table, s12_clean, s13_backfill, s14_unpivot,
        s15_candles, s16_epoch, s18_flatten, s19_latest, s20_documents, s22_head, p2_trades, p3_candles, t1_vwap, t1_trades, t2_dollar_bars,
        t2_daily, t2_cumulative, t3_roll_gaps, t4_rolled, t5_cusum, t5_cusum_long,
    )
}

SQL = {
    "s2_holdout": f"WITH {BARS_SQL} SELECT code, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS rn FROM bars) WHERE rn > 5",
    "s3_span": f"WITH {BARS_SQL} SELECT code, ts, close FROM bars WHERE ts BETWEEN DATE '1997-04-30' AND DATE '1997-06-30'",
    "s7_listing": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "s8_universe": f"WITH {BARS_SQL} SELECT code, ts, close FROM bars WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
    "s9_html_codes": "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([A-Za-z]+)\"', 1)) AS value FROM pages",
    "s10_hrefs": r"""SELECT page_id, CASE WHEN len(v) > 0 THEN 'https://site.test' || v[1] END AS url FROM (
        SELECT page_id, list_filter(regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]*)"', 1), lambda x: contains(x, 'th')) AS v FROM pages)""",
    "s11_html_table": f'WITH {BARS_SQL} SELECT code AS page_id, CAST(ts AS VARCHAR) AS "Date", CAST(CAST(close AS BIGINT) AS VARCHAR) AS "Adj_Close" FROM bars',
    "s12_clean": f"""WITH {BARS_SQL} SELECT code AS name, ts AS date,
        first_value(CASE WHEN volume % 3 = 0 THEN NULL ELSE close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts {_NEXT}) AS close FROM bars""",
    "s13_backfill": f"""WITH {BARS_SQL} SELECT code AS name, ts,
        first_value(CASE WHEN volume % 2 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts {_NEXT}) AS close FROM bars""",
    "s14_unpivot": f"""WITH {BARS_SQL} SELECT code, ts, 'open' AS name, open AS close FROM bars UNION ALL SELECT code, ts, 'high', high FROM bars
        UNION ALL SELECT code, ts, 'low', low FROM bars UNION ALL SELECT code, ts, 'close', close FROM bars""",
    "s15_candles": f"WITH {BARS_SQL} SELECT code, ts AS date, open, high, low, close FROM bars WHERE ts <= DATE '1997-12-31'",
    "s16_epoch": "SELECT event_id, date_trunc('second', ts) AS timestamp FROM events",
    "s18_flatten": """SELECT CAST(s_suppkey AS VARCHAR) AS code, 'n' || s_nationkey AS method, '2020-01-01' AS creat_time,
        '1992-01-01' AS data_range_start_to_compute, '1998-01-01' AS data_range_end_to_compute,
        'https://charts.test/n' || s_nationkey || '_' || s_suppkey || '.png' AS image_url FROM supplier""",
    "s19_latest": """SELECT o_orderpriority AS method, max(o_orderpriority || '_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS file,
        arg_max(o_custkey, o_orderpriority || '_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS o_custkey FROM orders GROUP BY 1""",
    "s20_documents": f"WITH {BARS_SQL} SELECT 'm' || (code % 5) AS method, code, round(avg(close / open - 1), 6) + 0.0 AS reward_rate_mean FROM bars GROUP BY code",
    "s22_head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100",
    "p2_trades": "SELECT event_id, ts AS time FROM events WHERE event_type = 'click'",
    "p3_candles": "SELECT ts AS date_time, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events WHERE event_type = 'click'",
    "t1_vwap": f"WITH {TICKS_SQL} SELECT symbol, round(sum(price * size) / nullif(sum(size), 0), 6) + 0.0 AS vwap FROM ticks GROUP BY symbol",
    "t1_trades": f"WITH {TICKS_SQL} SELECT symbol, seq, price, round(sum(price * size) OVER w / nullif(sum(size) OVER w, 0), 6) + 0.0 AS vwap FROM ticks WINDOW w AS (PARTITION BY symbol)",
    "t2_dollar_bars": f"""WITH RECURSIVE {TICKS_SQL}, num AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks
        ), walk AS (
          SELECT *, CAST(0 AS BIGINT) AS bar_id, price * size AS total FROM num WHERE rn = 1
          UNION ALL
          SELECT n.*, CASE WHEN total >= 20000 THEN bar_id + 1 ELSE bar_id END,
            CASE WHEN total >= 20000 THEN 0 ELSE total END + n.price * n.size FROM walk w JOIN num n ON n.symbol = w.symbol AND n.rn = w.rn + 1
        ) SELECT symbol, bar_id, min_by(price, rn) AS open, max(price) AS high, min(price) AS low, max_by(price, rn) AS close,
          CAST(sum(size) AS BIGINT) AS volume, round(sum(price * size), 6) + 0.0 AS dollars FROM walk GROUP BY symbol, bar_id HAVING max(total) >= 20000""",
    "t2_daily": """WITH RECURSIVE num AS MATERIALIZED (
          SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, CAST(ts AS DATE) AS day,
            row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events
        ), walk AS (
          SELECT *, CAST(0 AS BIGINT) AS bar_id, price * size AS total FROM num WHERE rn = 1
          UNION ALL
          SELECT n.*, CASE WHEN total >= 20000 THEN bar_id + 1 ELSE bar_id END,
            CASE WHEN total >= 20000 THEN 0 ELSE total END + n.price * n.size FROM walk w JOIN num n ON n.symbol = w.symbol AND n.day = w.day AND n.rn = w.rn + 1
        ) SELECT symbol, day, bar_id, min_by(price, rn) AS open, max(price) AS high, min(price) AS low, max_by(price, rn) AS close,
          CAST(sum(size) AS BIGINT) AS volume, round(sum(price * size), 6) + 0.0 AS dollars FROM walk GROUP BY symbol, day, bar_id HAVING max(total) >= 20000""",
    "t2_cumulative": f"""WITH {TICKS_SQL}, c AS (
          SELECT *, CAST(floor(coalesce(sum(price * size) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS BIGINT) AS bar_id,
            row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks
        ) SELECT symbol, bar_id, min_by(price, rn) AS open, max(price) AS high, min(price) AS low, max_by(price, rn) AS close,
          CAST(sum(size) AS BIGINT) AS volume, round(sum(price * size), 6) + 0.0 AS dollars FROM c GROUP BY symbol, bar_id""",
}
_ROLL = f"""WITH {BARS_SQL}, j AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY code, strftime(ts, '%Y%m') ORDER BY ts) = 1 THEN coalesce(open - lag(close) OVER (PARTITION BY code ORDER BY ts), 0) ELSE 0 END AS jump FROM bars
), g AS (
  SELECT *, sum(jump) OVER (PARTITION BY code ORDER BY ts) - sum(jump) OVER (PARTITION BY code) AS gap FROM j
)"""
SQL |= {
    "t3_roll_gaps": f"{_ROLL} SELECT code, ts, gap FROM g",
    "t4_rolled": f"{_ROLL} SELECT code, ts, close - gap AS close FROM g",
    "t5_cusum": f"WITH RECURSIVE {BARS_SQL}, {cusum_sql(30)} SELECT code, t0 FROM cusum",
    "t5_cusum_long": f"WITH RECURSIVE {BARS_SQL}, {cusum_sql(20)} SELECT code, t0 FROM cusum",
}
