"""Query registry, DuckDB oracle text, materialised refresh and plan checks."""

from cabflow.plans.oracle import oracle_sql
from cabflow.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
