"""All catalogue queries by name, and their SQL."""

from vetrina.plans import feed_queries, import_queries, level_queries, search_queries, snapshot_queries, state_queries, text_queries  # noqa: F401  they register their queries
from vetrina.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
