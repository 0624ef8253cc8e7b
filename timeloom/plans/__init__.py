"""Registered queries of the timeline operators and their SQL counterparts."""

from . import more_queries, other_queries, picture_queries, session_queries, timeline_queries
from .timeline_queries import flagship  # noqa: F401

QUERIES = timeline_queries.QUERIES | other_queries.QUERIES | more_queries.QUERIES | picture_queries.QUERIES | session_queries.QUERIES
ORACLE_SQL = timeline_queries.ORACLE_SQL | other_queries.ORACLE_SQL | more_queries.ORACLE_SQL | picture_queries.ORACLE_SQL | session_queries.ORACLE_SQL
