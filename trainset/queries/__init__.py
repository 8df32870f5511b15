"""Registered queries and their SQL twins, grouped by subject."""

from trainset.queries.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
