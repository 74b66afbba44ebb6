"""All registered queries of the photo engine and their oracle SQL."""

from __future__ import annotations

from . import people_queries, search_queries, source_queries, stream_queries, time_queries

_PARTS = (search_queries, people_queries, time_queries, source_queries, stream_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
