"""All named queries; importing this module registers them."""

from footfall.plans import (  # noqa: F401
    activity_queries,
    content_queries,
    customer_queries,
    source_queries,
)
from footfall.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
