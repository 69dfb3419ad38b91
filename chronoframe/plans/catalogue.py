"""All registered queries over the driver's tables, with the SQL each of them equals."""

from __future__ import annotations

from . import fundamental_queries, history_queries, panel_queries, portfolio_queries, remaining_queries, score_queries, screening_queries, source_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fundamental_queries", "history_queries", "panel_queries", "portfolio_queries", "remaining_queries", "score_queries", "screening_queries", "source_queries"]
