"""The operators bound to the given tables, each with the SQL that must agree."""

from __future__ import annotations

from importlib import import_module

MODULES = ["chunks", "search", "questions", "pages", "posts", "trees", "scores"]


def load() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = import_module(f"bindings.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
