"""Registered queries: each id pairs a Spark DataFrame plan with its oracle SQL."""
from .registry import QUERIES, ORACLE, query  # noqa: F401
from . import q_relational, q_cohort, q_text, q_vocab, q_split, q_graph, q_metrics  # noqa: F401,E402
