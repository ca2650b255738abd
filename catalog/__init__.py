"""Registered queries over the given tables, with SQL oracles."""

from . import graph_checks, match_checks, quality_checks, read_checks, scoring_checks, source_checks, stream_checks  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
