"""Named queries, each with the SQL it is compared with."""

from __future__ import annotations

import importlib

from graphloom.plans.registry import CORE, Registry

MODULES = ("references", "nested", "hierarchy", "stored", "graphs", "relational", "text", "assurance", "rules", "streams", "incremental", "statements")


def load_core() -> Registry:
    """The core registry, with every query module imported."""
    for name in MODULES:
        importlib.import_module(f"graphloom.plans.{name}")
    return CORE
