"""All queries of the search and analytics operators with their SQL."""

from __future__ import annotations

from talkloom.plans import list_queries, search_queries, store_queries, sync_queries, topic_queries

_MODULES = (search_queries, topic_queries, store_queries, list_queries, sync_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
