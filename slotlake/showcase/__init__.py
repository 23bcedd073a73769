"""Registered queries, each with the SQL that gives the same rows (or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("imports", "cells", "lifecycle", "status", "config")


def all_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        queries = import_module(f"slotlake.showcase.{name}").QUERIES
        doubled = found.keys() & queries.keys()
        if doubled:
            raise ValueError(f"registered twice: {sorted(doubled)}")
        found.update(queries)
    return found
