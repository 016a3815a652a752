"""All queries of the library, by importing the modules that register them."""

from __future__ import annotations

import importlib

from rowforge.plans import registry

MODULES = ("predicates", "scalar_queries", "aggregates", "joins", "windows", "jobs")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"rowforge.plans.{m}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
