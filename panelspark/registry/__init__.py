"""All registered queries, by name."""

from panelspark.registry import draw_queries, panel_queries, policy_queries, shock_queries  # noqa: F401
from panelspark.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
