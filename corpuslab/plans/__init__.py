"""Registered queries: each a function of (spark, folder) with its SQL twin."""

from corpuslab.plans import cleaning, context, corpus, evaluation, findings, language, scores, tables  # noqa: F401  (they register themselves)
from corpuslab.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
