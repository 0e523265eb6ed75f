"""Queries over the driver tables, grouped by theme."""

from __future__ import annotations

import importlib

MODULES = ["windows", "sources", "relational", "composition", "distribution", "forecast", "scoring", "events", "tasks", "streams"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
