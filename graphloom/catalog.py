"""Registry of the engine's queries and of the SQL that gives the same rows."""

from graphloom.plans import graph_queries, learned_queries, result_queries, source_queries, spectral_queries  # noqa: F401
from graphloom.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
