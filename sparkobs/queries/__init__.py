"""Registered queries: each applies operators to the driver's tables and has a DuckDB twin where SQL can express it."""

from __future__ import annotations

from sparkobs.queries import filters, metric_queries, observe_queries, panels, rollup_queries, row_queries, source_queries, sql_queries  # noqa: F401
from sparkobs.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
