"""All queries of the library, and the SQL that they are held against."""

from __future__ import annotations

from folioscope.plans import decision_queries, index_queries, queries

_MODULES = (queries, index_queries, decision_queries)

QUERIES: dict[str, queries.Query] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
