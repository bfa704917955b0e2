"""Collects the registered queries and their SQL twins from the catalogs."""

from __future__ import annotations

import importlib

CATALOGS = ["profile", "features", "prep", "images", "models", "trees", "stream"]


def all_queries() -> dict:
    out = {}
    for name in CATALOGS:
        out.update(importlib.import_module(f"tessera.plans.catalog_{name}").QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for name in CATALOGS:
        try:
            mod = importlib.import_module(f"tessera.plans.oracle_{name}")
        except ModuleNotFoundError:
            continue
        out.update(mod.SQL)
    return out
