"""Collects the registered queries of the library's modules."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("kinlink.operators.queries_decide", "kinlink.operators.queries_block", "kinlink.operators.queries_text", "kinlink.operators.queries_candidates", "kinlink.operators.queries_sources", "kinlink.operators.queries_reports")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in importlib.import_module(m).ORACLE_SQL.items()}
