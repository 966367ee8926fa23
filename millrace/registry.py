"""Queries of all operator modules, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = [
    "sources.files",
    "sources.gateway",
    "operators.relational",
    "operators.series",
    "operators.quality_dimensions",
    "operators.quality_audit",
    "operators.statistics",
    "operators.finance",
    "operators.strategies",
    "operators.planning",
    "operators.text",
    "plans.sqltools",
    "streaming.state",
    "streaming.timers",
]

QUERIES: dict = {}
SQL: dict = {}
OPS: dict = {}
for _name in MODULES:
    _r = importlib.import_module(f"millrace.{_name}").R
    QUERIES |= _r.queries
    SQL |= _r.sql
    OPS |= _r.ops
