"""Imports every query module, so the registry is complete."""
from tsudoi.plans import export_queries, match_queries, page_queries, reaction_queries, rule_queries, schedule_queries, state_queries  # noqa: F401
from tsudoi.plans.registry import ORACLES, QUERIES  # noqa: F401
