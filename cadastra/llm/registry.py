"""The queries of this package and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = [
    "decontaminate",
    "simhash",
    "line_dedup",
    "url_filter",
    "quality",
    "toxicity",
    "piece_codec",
    "sharding",
    "license_scan",
    "media_avi",
]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"cadastra.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
