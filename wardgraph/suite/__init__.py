"""Queries over the driver tables, each beside the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = ["flow", "facts", "graph", "scalars", "tables", "vectors", "notes"]


def load() -> tuple[dict, dict]:
    """All queries and their checks."""
    for name in MODULES:
        importlib.import_module(f"wardgraph.suite.{name}")
    from wardgraph.suite.registry import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
