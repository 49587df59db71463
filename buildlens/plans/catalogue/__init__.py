"""The query catalogue; importing it registers every query."""

from . import evaluation, models, profiles, rows, sequence_queries, source_queries, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
