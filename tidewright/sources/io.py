"""Readers and writers of the jobs' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column names and types of the external files.
DAILY = "Date date, Open double, High double, Low double, Close double, Adj_Close double, Volume long"
TRADES = (
    "timestamp string, symbol string, side string, size long, price double, tickDirection string, trdMatchID string, "
    "grossValue double, homeNotional double, foreignNotional double"
)
SELECTION = (
    "result_code_list array<string>, method string, creat_time string, data_range_start_to_compute string, "
    "data_range_end_to_compute string, back_test_return_date int, elapsed_time_average double"
)


def write_bars_csv(bars: DataFrame, path: str) -> None:
    """A folder ``code=<code>`` of CSV files for each code; a code's rows lie in one file."""
    names = [c.split()[0] for c in DAILY.split(", ")]
    rows = bars.select("code", *[F.col("ts" if n == "Date" else n.lower()).alias(n) for n in names])
    rows.repartition("code").sortWithinPartitions("code", "Date").write.partitionBy("code").csv(path, header=True)


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-code CSV files as one bars table; the code is that of the folder ``code=1332``, else the file's name (``1332.csv``)."""
    rows = spark.read.option("recursiveFileLookup", True).schema(DAILY).csv(path, header=True)
    folder = F.regexp_extract(F.input_file_name(), r"/code=([^/]+)/[^/]*$", 1)
    return rows.select(
        F.when(folder != "", folder).otherwise(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:\.gz)?$", 1)).alias("code"),
        F.col("Date").alias("ts"),
        *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Adj_Close", "Volume")],
    )


def read_trades_csv(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """All trade files together, duplicates kept; gzip files do not split, so they can be dealt anew."""
    rows = spark.read.schema(TRADES).csv(paths, header=True)
    return rows.repartition(partitions) if partitions else rows


def read_tournament_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV; feature and target columns as FLOAT."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.col(c).cast("float") if "feature" in c or "target" in c else F.col(c) for c in rows.columns])


def write_stage(df: DataFrame, root: str, stage: str, key: str = "code") -> None:
    """A stage's table, partitioned by key; rewriting replaces it."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(f"{root}/{stage}")


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}")


def write_selection_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def read_selection_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTION).json(path).withColumn("file", F.input_file_name())


def write_predictions_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
