"""The registered queries and their SQL."""

from __future__ import annotations

from . import queries_detail, queries_graph, queries_influence, queries_readers, queries_records, queries_relations, queries_search, queries_terminals, queries_time, queries_timeline
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "event_kinds"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "queries_detail", "queries_graph", "queries_influence", "queries_readers", "queries_records", "queries_relations", "queries_search", "queries_terminals", "queries_time", "queries_timeline"]
