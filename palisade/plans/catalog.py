"""Imports every query module, so that the registry is complete."""

from palisade.plans import (  # noqa: F401
    audit_queries,
    discover_queries,
    governed_queries,
    ingest_queries,
    integrity_queries,
    lineage_queries,
    mask_queries,
    policy_queries,
    retrieval_queries,
    risk_queries,
    sparse_queries,
    stream_queries,
)
from palisade.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
