"""All registered queries of the audit engine and their SQL."""

from __future__ import annotations

from .plans import audit_queries, corpus_queries, reading_queries, review_queries, rule_queries, scan_queries, source_queries, stream_queries

FLAGSHIP = "purchases_by_product"
_PARTS = (audit_queries, corpus_queries, reading_queries, review_queries, rule_queries, scan_queries, source_queries, stream_queries)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
