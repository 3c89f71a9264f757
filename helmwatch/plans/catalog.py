"""All queries of the library's own operators and the SQL they are held against."""

from __future__ import annotations

from helmwatch.plans import diagnostic_queries, evaluation_queries, health_queries, model_queries, quality_queries, registry_queries, report_queries, scan_queries, selection_queries, sequence_queries

_PARTS = (sequence_queries, quality_queries, evaluation_queries, health_queries, diagnostic_queries, model_queries, report_queries, selection_queries, scan_queries, registry_queries)

QUERIES = {name: pair[0] for part in _PARTS for name, pair in part.QUERIES.items()}
ORACLES = {name: pair[1] for part in _PARTS for name, pair in part.QUERIES.items() if pair[1]}
