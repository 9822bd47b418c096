"""Queries over the shared tables, by theme; each module registers its own."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "telemetry", "resolve", "graph", "changes", "guard", "evaluate", "relational", "document", "packing")


def register() -> None:
    """Imports the modules that register queries."""
    for m in MODULES:
        importlib.import_module(f"lorespark.plans.{m}")
