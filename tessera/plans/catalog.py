"""Every registered query: importing this module fills the registry."""

from __future__ import annotations

from . import identity_queries, lab_queries, scoring_queries, source_queries, stats_queries, window_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
