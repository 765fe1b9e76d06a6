"""All registered queries of the graph engine."""

from weft import algebra_queries, belief_queries, concept_queries, inference_queries, more_queries, rule_queries, state_queries, structure_queries  # noqa: F401  add their queries
from weft.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
