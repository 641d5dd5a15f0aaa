"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from tempograph.plans import bound_queries, chart_queries, event_queries, operator_queries, source_queries, symbolic_queries, text_queries, vector_queries

FLAGSHIP = "symbolic_chords"
_ALL = {**event_queries.FOUND, **symbolic_queries.FOUND, **vector_queries.FOUND, **text_queries.FOUND, **source_queries.FOUND, **operator_queries.FOUND, **chart_queries.FOUND, **bound_queries.FOUND}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
