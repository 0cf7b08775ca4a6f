"""The queries of the llm operators and their SQL."""

from __future__ import annotations

import importlib

#: Modules of this subpackage that hold QUERIES and SQL.
MODULES = ("queries_records", "queries_text", "queries_pages", "queries_results")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"weftline.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
