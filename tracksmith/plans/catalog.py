"""Registered queries and the SQL that each must equal."""

from __future__ import annotations

from tracksmith.plans import artifact_queries, audit_queries, evaluation_queries, more_queries, record_queries, recovery_queries, session_queries, splits_queries, trajectory_queries, wider_queries  # noqa: F401
from tracksmith.plans.splits_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
