"""Importing this module registers every query."""

from workload import answer_queries, rules_queries, table_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
