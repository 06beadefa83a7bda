"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from evidence_lake.plans import chunk_queries, search_queries, service_queries, workflow_queries

_PARTS = (chunk_queries, search_queries, workflow_queries, service_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
