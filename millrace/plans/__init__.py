"""Queries, the tables they stand on, stages and state machines."""

from millrace.plans import by_order, by_rest, by_rule, by_set  # noqa: F401  (they register their queries)
from millrace.plans.catalog import ORACLE as SQL
from millrace.plans.catalog import QUERIES

__all__ = ["QUERIES", "SQL"]
