"""Corpus operators for training-data pipelines, one module each.

Nothing else in the library imports this package; it registers its own queries.
"""

from __future__ import annotations

import importlib

MODULES = ("chat", "language", "media", "mixing", "neardup", "packing", "periodic", "private", "quality", "repeats", "token_counts", "toxicity", "whitening")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f".{m}", __name__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f".{m}", __name__).ORACLES.items()}
