"""All queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from tidewire.plans import catalog, fold_queries

QUERIES = {**catalog.QUERIES, **fold_queries.QUERIES}
ORACLE_SQL = dict(catalog.ORACLE_SQL)
