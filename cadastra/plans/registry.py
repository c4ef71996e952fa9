"""Queries of the engine's own operators and the SQL that says the same."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "panel_queries", "domain_queries", "serving_queries", "notice_queries"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"cadastra.plans.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
