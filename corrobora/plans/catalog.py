"""All registered queries."""

from corrobora.plans import fusion_queries, monitor_queries, prepare_queries  # noqa: F401
from corrobora.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
