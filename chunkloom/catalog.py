"""Registered queries of the content-delivery engine, with the SQL that checks them."""

from __future__ import annotations

from .plans import analysis, artifacts, compare, content, cost, delivery, exchange, forms, graph, sessions, store

_AREAS = (analysis, compare, store, content, artifacts, graph, cost, sessions, delivery, exchange, forms)

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL = {name: sql for area in _AREAS for name, sql in area.ORACLE_SQL.items()}
