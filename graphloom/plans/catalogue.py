"""All queries over the driver's tables and the SQL that they must agree with."""

from __future__ import annotations

from graphloom.plans import graph_queries, group_queries, symbol_queries, text_queries

_ALL = [*graph_queries.CATALOGUE, *group_queries.CATALOGUE, *text_queries.CATALOGUE, *symbol_queries.CATALOGUE]
QUERIES = {q.name: q.run for q in _ALL}
ORACLE_SQL = {q.name: q.sql for q in _ALL if q.sql}
