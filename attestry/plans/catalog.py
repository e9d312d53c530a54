"""All registered queries."""

from __future__ import annotations

from attestry.plans import (  # noqa: F401
    claim_queries,
    ingest_queries,
    retrieval_queries,
    review_queries,
    stream_queries,
)
from attestry.plans.claim_queries import flagship
from attestry.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "flagship"]
