"""All registered queries."""

from scorelens.plans import (  # noqa: F401
    comparison_queries,
    evaluation_queries,
    pairing_queries,
    selection_queries,
    source_queries,
    statistics_queries,
)
from scorelens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
