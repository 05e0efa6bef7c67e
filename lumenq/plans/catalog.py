"""All core queries: importing the modules below registers them."""

from lumenq.plans import queries_rules, queries_text
from lumenq.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_rules", "queries_text"]
