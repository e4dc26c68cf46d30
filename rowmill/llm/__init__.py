"""Operators for training-data pipelines, and their registered queries."""

from rowmill.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
