"""Queries that write tables in the jobs' file formats to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import shared_path
from ..operators import bars as B
from ..operators import fracdiff as D
from ..operators import scoring as N
from ..operators.validation import label_histogram
from ..sources import io
from ..sources.adapters import BARS_SQL, bars, table
from .common import rounded

COLUMNS = 64  # of an embedding
NAMES = [f"feature_{N.GROUPS[k % len(N.GROUPS)]}{k}" for k in range(COLUMNS)]


def s1_bars_csv(spark, d):
    path = shared_path(spark, "bars-csv")
    rows = bars(spark, d)
    io.write_bars_csv(rows.withColumns({"adj_close": F.col("close"), "volume": F.col("volume").cast("long")}), path)
    return io.read_bars_csv(spark, path).select(F.col("code").cast("long").alias("code"), "ts", "open", "high", "low", "close", "volume")


def s4_trades_csv(spark, d):
    path = shared_path(spark, "trades-csv")
    events = table(spark, d, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'D'HH:mm:ss.SSSSSS"), F.lit("000"))
    names = [c.split()[0] for c in io.TRADES.split(", ")]
    known = {"timestamp": stamp, "symbol": F.col("event_type"), "size": F.get_json_object("props", "$.k").cast("long"), "price": F.col("value"), "trdMatchID": F.col("event_id").cast("string")}
    rows = events.select(*[known.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    rows.write.csv(path, header=True, compression="gzip")
    read = B.parse_trades(io.read_trades_csv(spark, [path]))
    return read.select(F.col("trdMatchID").cast("long").alias("event_id"), "symbol", F.col("time"), "size", "price")


def _wide(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), *[F.get("embedding", F.lit(k)).alias(c) for k, c in enumerate(NAMES)])


def s5_tournament_csv(spark, d):
    path = shared_path(spark, "tournament-csv")
    _wide(spark, d).write.csv(path, header=True)
    read = io.read_tournament_csv(spark, path)
    total = sum((F.col(c).cast("double") for c in NAMES), F.lit(0.0))
    return rounded(read.select(F.col("id").cast("long").alias("vec_id"), total.alias("total")), "total")


def s6_stage(spark, d):
    folder = shared_path(spark, "stages")
    io.write_stage(bars(spark, d), folder, "bars")
    return io.read_stage(spark, folder, "bars").select(F.col("code").cast("long").alias("code"), "ts", "close")


def s17_selection_json(spark, d):
    path = shared_path(spark, "selection-json")
    codes = F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")).alias("result_code_list")
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("method")).agg(codes)
    rest = {"creat_time": "2020-01-01", "data_range_start_to_compute": "a", "data_range_end_to_compute": "b"}
    rows = rows.withColumns({k: F.lit(v) for k, v in rest.items()}).withColumns({"back_test_return_date": F.lit(0), "elapsed_time_average": F.lit(1.5)})
    io.write_selection_json(rows, path)
    read = io.read_selection_json(spark, path)
    return read.select("method", F.explode("result_code_list").alias("code"), "creat_time", "elapsed_time_average")


def s21_predictions_csv(spark, d):
    path = shared_path(spark, "predictions")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("prediction"))
    io.write_predictions_csv(rows, path)
    return spark.read.schema("id long, prediction double").csv(path, header=True)


def p1_value(spark, d):
    return B.value_column(bars(spark, d), "close")


def p5_groups(spark, d):
    return N.feature_group_counts(_wide(spark, d))


def f6_stack(spark, d):
    rows = bars(spark, d)
    parts = [rows.where(F.pmod("code", F.lit(2)) == k) for k in (0, 1)]
    return rounded(D.stack([D.frac_diff_ffd(p, ["close"], 0.4, 1e-2) for p in parts]), "fd_close")


def _means(spark, d):
    wide = _wide(spark, d)
    return N.column_means(wide.select(*[F.col(c).cast("double") for c in NAMES]), NAMES)


def n3_histogram(spark, d):
    return label_histogram(_means(spark, d), "mean")


def n3_shape(spark, d):
    return N.shape(_wide(spark, d))


def p5_file(spark, d):
    """Columns and values of each group in a tournament file, with the columns that the file itself names."""
    path = shared_path(spark, "tournament-csv")
    _wide(spark, d).write.csv(path, header=True)
    return N.feature_group_cells(io.read_tournament_csv(spark, path))


QUERIES = {
    f.__name__: f
    for f in (s1_bars_csv, s4_trades_csv, s5_tournament_csv, s6_stage, s17_selection_json, s21_predictions_csv, p1_value, p5_groups, p5_file, f6_stack, n3_histogram, n3_shape)
}

_W = D.weights_ffd(0.4, 1e-2).tolist()
SQL = {
    "s1_bars_csv": f"WITH {BARS_SQL} SELECT code, ts, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(volume AS BIGINT) AS volume FROM bars",
    "s4_trades_csv": "SELECT event_id, event_type AS symbol, ts AS time, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, value AS price FROM events",
    "s5_tournament_csv": f"SELECT vec_id, round({' + '.join(f'CAST(embedding[{k + 1}] AS DOUBLE)' for k in range(COLUMNS))}, 6) + 0.0 AS total FROM embeddings",
    "s6_stage": f"WITH {BARS_SQL} SELECT code, ts, close FROM bars",
    "s17_selection_json": "SELECT c_mktsegment AS method, CAST(c_custkey AS VARCHAR) AS code, '2020-01-01' AS creat_time, CAST(1.5 AS DOUBLE) AS elapsed_time_average FROM customer",
    "s21_predictions_csv": "SELECT vec_id AS id, label / 10 AS prediction FROM embeddings",
    "p1_value": f"WITH {BARS_SQL} SELECT code, ts, close FROM bars",
    "p5_groups": " UNION ALL ".join(f"SELECT '{g}' AS \"group\", CAST({sum(n.startswith(f'feature_{g}') for n in NAMES)} AS BIGINT) AS n" for g in N.GROUPS),
    "p5_file": f"""WITH n AS (SELECT unnest(range(1, {COLUMNS + 1})) AS k, unnest({NAMES}) AS name), c AS (SELECT name, count(embedding[k]) AS cells FROM embeddings, n GROUP BY name)
        SELECT CASE {" ".join(f"WHEN contains(name, '{g}') THEN '{g}'" for g in N.GROUPS)} END AS "group", count(*) AS n, CAST(sum(cells) AS BIGINT) AS cells FROM c WHERE cells > 0 GROUP BY 1""",
    "f6_stack": f"""WITH {BARS_SQL}, x AS (SELECT code, ts, list(close) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN {len(_W) - 1} PRECEDING AND CURRENT ROW) AS x FROM bars)
        SELECT code, ts, round(list_dot_product(x, CAST({_W[::-1]} AS DOUBLE[])), 6) + 0.0 AS fd_close FROM x WHERE len(x) = {len(_W)}""",
    "n3_histogram": f"""WITH m AS (SELECT k, avg(CAST(embedding[k] AS DOUBLE)) AS mean FROM embeddings, (SELECT unnest(range(1, {COLUMNS + 1})) AS k) GROUP BY k), e AS (SELECT min(mean) AS a, max(mean) AS b FROM m)
        SELECT CAST(least(floor((mean - a) / (b - a) * 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM m, e GROUP BY 1""",
    "n3_shape": f"SELECT count(*) AS n_rows, CAST({COLUMNS + 1} AS BIGINT) AS n_columns FROM embeddings",
}
