"""Queries over the driver's tables, each with the SQL that checks it (or None)."""

from __future__ import annotations

from cantata.plans import scoring_queries, signal_queries, text_queries


def _all() -> dict:
    return text_queries.QUERIES | signal_queries.QUERIES | scoring_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
