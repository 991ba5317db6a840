"""Queries over the driver's tables seen as array variables, with equivalent SQL."""

from __future__ import annotations

from tessella.plans import algebra, metadata, sources, values
from tessella.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "algebra", "metadata", "sources", "values"]
