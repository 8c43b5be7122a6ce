"""Registered queries."""

from seqfold.plans import more_queries, queries, source_queries, store_queries  # noqa: F401
from seqfold.plans.registry import ORACLES, QUERIES  # noqa: F401
