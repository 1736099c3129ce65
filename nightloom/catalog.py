"""The registered queries of the signal library and their SQL."""

from __future__ import annotations

from nightloom.plans.oracle import oracle_sql
from nightloom.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
