"""All queries of the core, and the SQL that states the same results."""

from __future__ import annotations

import importlib

MODULES = ("quality", "text", "intervals", "splits", "audit", "manifest", "retrieval", "align")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"cohortloom.plans.{m}").QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"cohortloom.plans.{m}").SQL.items()}
