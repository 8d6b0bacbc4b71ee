"""Every query of the engine, by name, with the SQL that gives the same rows."""

from corpusmill.plans import aggregates, answers, changes, feeds, filters, joins, places, search, texts  # noqa: F401
from corpusmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
