"""The registered queries: the library's jobs wired to the given tables."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("marts", "texts", "impact", "evaluation", "network", "checks", "journeys")
for _m in MODULES:
    importlib.import_module(f".{_m}", __name__)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
