"""Catalog of runnable queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

from sparktext.plans.catalog.registry import ORACLES, QUERIES

for _name in ("cleaning", "profiles", "ordering", "vectorising", "weighting", "dense", "evaluation", "models", "storage"):
    import_module(f"sparktext.plans.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
