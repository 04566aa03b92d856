"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("neighbours", "distinctive", "handwritten", "outranking", "syntax", "documented", "secrets", "containers", "leaks", "sentences")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"siftspark.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
