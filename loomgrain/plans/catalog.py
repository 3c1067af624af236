"""All registered queries of the core."""

from loomgrain.plans import code_queries, feature_queries, finding_queries, match_queries, scoring_queries, stream_queries  # noqa: F401
from loomgrain.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
