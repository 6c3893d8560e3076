"""Registered queries of the panel, text and event operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from .plans import composite_queries, market_queries, panel_queries, review_queries, suite_queries, text_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "asof_forward_lag_gate"
