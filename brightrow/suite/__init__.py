"""Reference queries over the test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib

from brightrow.suite.registry import QUERIES, SQL

MODULES = ("strings", "rows", "stats", "series", "duplicates", "checks", "questions", "files", "plans", "streams")

for _name in MODULES:
    importlib.import_module(f"brightrow.suite.{_name}")

__all__ = ["QUERIES", "SQL"]
