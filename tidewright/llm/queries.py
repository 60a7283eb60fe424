"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import importlib

_MODULES = ["op1_token_counts", "op2_quality_rules", "op3_token_files", "op4_bloom_lm", "op5_decontaminate", "op6_line_dedup", "op7_source_mix", "op8_language_id", "op9_url_filter", "op10_minhash", "op11_vector_codes", "op12_importance_draw", "op13_best_fit"]


def _loaded():
    return [importlib.import_module(f"tidewright.llm.{m}") for m in _MODULES]


def queries():
    return {m.NAME: m.query for m in _loaded()}


def oracle_sql():
    return {m.NAME: m.SQL for m in _loaded() if m.SQL is not None}
