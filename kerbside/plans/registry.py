"""Registered queries and their SQL, without those of the llm folder."""

from __future__ import annotations

from kerbside.plans import geometry, scenes, streams, tracks

_PARTS = (geometry, scenes, tracks, streams)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
