"""All registered queries."""

from lingospan.plans import file_queries, join_queries, text_queries, topic_queries, vector_queries  # noqa: F401
from lingospan.plans.registry import BUILDERS, ORACLES, QUERIES

__all__ = ["BUILDERS", "ORACLES", "QUERIES"]
