"""Registered queries: each operator over the given tables, next to its SQL statement."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "search", "questions", "passages", "stems", "graph", "parsing", "chunks", "tables", "reports", "activity",
    "sketches", "streams",
)


def collect() -> tuple[dict, dict]:
    """All registered queries and SQL statements, by name."""
    queries, oracles = {}, {}
    for family in FAMILIES:
        module = import_module(f"scholion.plans.{family}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
