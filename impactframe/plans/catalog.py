"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from impactframe.plans import margin_queries, payload_queries, quality_queries, ridge_queries, store_queries, table_queries

_GROUPS = [margin_queries, ridge_queries, quality_queries, table_queries, payload_queries, store_queries]

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
