"""Named queries over the driver tables: one entry per operator, each a callable (spark, folder) -> DataFrame."""

from tradewinds.registry import check_queries, layer_queries
from tradewinds.registry.base import all_queries

__all__ = ["all_queries", "check_queries", "layer_queries"]
