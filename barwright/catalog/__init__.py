"""Every registered query with its SQL counterpart."""

import importlib

from barwright.catalog import registry

MODULES = ["indicators", "aggregates", "book", "strategy", "fundamentals", "investors", "landing", "streams"]
for _m in MODULES:
    importlib.import_module(f"barwright.catalog.{_m}")

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
