"""The named queries of the engine and their SQL oracles."""

from __future__ import annotations

from . import audit_queries, match_queries, record_queries, source_queries, text_queries

PARTS = (match_queries, audit_queries, text_queries, source_queries, record_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
