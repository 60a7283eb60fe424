"""Scores of tournament predictions, and facts about wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import POSITION, positions

#: The feature groups of the tournament table.
GROUPS = ["wisdom", "intelligence", "charisma", "strength", "dexterity", "constitution"]


def pct_rank_first(rows: DataFrame, pred: str = "pred", row: str = "row") -> DataFrame:
    """Adds ``rank``: position / n, ties by input order.  Range-partitioned, then offset: no single task."""
    numbered = positions(rows, [pred, row])
    n = numbered.agg(F.count("*").alias("_n"))
    return numbered.join(F.broadcast(n)).withColumn("rank", (F.col(POSITION) + 1) / F.col("_n")).drop("_n", POSITION)  # one row


def score_corr(ranked: DataFrame, target: str = "target") -> DataFrame:
    return ranked.agg(F.corr(target, "rank").alias("score"))


def column_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mean`` of every column, in one pass."""
    return rows.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], columns, "column", "mean")


def shape(rows: DataFrame) -> DataFrame:
    """``n_rows, n_columns`` of a table."""
    return rows.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(rows.columns)).cast("long"))


def feature_columns(rows: DataFrame, word: str = "feature") -> list[str]:
    return [c for c in rows.columns if word in c]


def _group(name: str) -> Column:
    return F.coalesce(*[F.when(F.contains(name, F.lit(g)), F.lit(g)) for g in GROUPS])


def feature_group_cells(rows: DataFrame) -> DataFrame:
    """``group, n, cells``: the feature columns of each group that hold a value in some row, and their values."""
    names = feature_columns(rows)
    cells = rows.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "name", "cells").where("cells > 0")
    return cells.groupBy(_group("name").alias("group")).agg(F.count("*").alias("n"), F.sum("cells").alias("cells")).where("group IS NOT NULL")


def feature_group_counts(rows: DataFrame) -> DataFrame:
    """``group, n``: feature columns by the first group name that they hold."""
    names = rows.sparkSession.createDataFrame([(c,) for c in feature_columns(rows)], "name string")
    return names.groupBy(_group("name").alias("group")).agg(F.count("*").alias("n")).where("group IS NOT NULL")
