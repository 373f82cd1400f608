"""Importing the query modules fills the catalogue."""

from graphlens.plans import change_queries, community_queries, enrich_queries, link_queries, model_queries, question_queries, resolve_queries, rule_queries, source_queries, stream_queries, text_queries, traverse_queries, usage_queries, view_queries  # noqa: F401
from graphlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
