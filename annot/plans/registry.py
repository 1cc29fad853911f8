"""All queries of the library outside the subpackage llm, and the SQL they are held against."""

from __future__ import annotations

from . import dedup_queries, group_queries, learn_queries, profile_queries, sequence_queries, source_queries

_MODULES = (dedup_queries, profile_queries, group_queries, source_queries, sequence_queries, learn_queries)


def queries() -> dict:
    return {n: f for m in _MODULES for n, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _MODULES for n, (_, s) in m.QUERIES.items() if s}
