"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sentences", "canonical", "splitting", "neighbours", "topics", "tokenizer", "leakage", "stuffing")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tessera.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
