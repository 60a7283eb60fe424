"""Names of the registered market-data queries, with their DuckDB SQL."""

from __future__ import annotations

from . import file_queries, learning_queries, model_queries, report_queries, selection_queries, source_queries

MODULES = [source_queries, file_queries, selection_queries, learning_queries, report_queries, model_queries]


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
