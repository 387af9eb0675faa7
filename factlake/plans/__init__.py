"""Named queries and their SQL."""

from factlake.plans import report_queries, text_queries  # noqa: F401  # register their queries
from factlake.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
