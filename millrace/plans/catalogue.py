"""All registered queries."""

from millrace.plans import corpus_queries, curation_queries, evaluation_queries, journal_queries, relational_queries, source_queries  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
