"""All named queries of the subpackage, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("history_plans", "match_plans", "name_plans", "corpus_plans")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in importlib.import_module(f"ledgerloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in importlib.import_module(f"ledgerloom.llm.{m}").SQL.items()}
