"""Every query of the library outside llm, with its SQL."""

from __future__ import annotations

from .plans import queries_more, queries_state, queries_text
from .plans.queries_graph import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_more", "queries_state", "queries_text"]
