"""All registered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from factloom.plans import audit_queries, document_queries, evidence_queries, function_queries, research_queries, run_queries, score_queries, source_queries, stream_queries  # noqa: F401  they register their queries
from factloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
