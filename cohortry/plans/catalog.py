"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from cohortry.plans import cohorts, comparisons, constraints, contexts, profiles, reviews  # noqa: F401
from cohortry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
