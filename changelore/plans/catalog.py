"""All registered queries."""

from __future__ import annotations

from changelore.plans import (  # noqa: F401
    chunk_queries,
    eval_queries,
    history_queries,
    lineage_queries,
    retrieval_queries,
    scalar_queries,
)
from changelore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
