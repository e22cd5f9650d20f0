"""Registered queries and the SQL that each is held against."""

from __future__ import annotations

from plumbline.plans import queries_retrieval, queries_state, queries_stats, queries_text, queries_trust

_PARTS = (queries_text, queries_retrieval, queries_trust, queries_stats, queries_state)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
