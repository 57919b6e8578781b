"""Registered queries and their SQL."""

from textmill.plans import corpus, details, roundtrips, search, wholes  # noqa: F401  (registers)
from textmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
