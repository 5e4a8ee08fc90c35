"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = [
    "analysis", "spatial", "alloc", "sources", "relational", "employment", "assessor", "base",
    "scenario", "quality",
]


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"landspan.queries.{name}")
    return importlib.import_module("landspan.queries.registry")
