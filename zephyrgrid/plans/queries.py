"""All registered queries."""

from zephyrgrid.plans import column_queries, model_queries, ranked_queries, season, series_queries, source_queries  # noqa: F401
from zephyrgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
