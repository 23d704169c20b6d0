"""Queries over the tables, one module for each family of operators."""

from __future__ import annotations

from types import ModuleType


def registered() -> list[ModuleType]:
    """The modules with queries() and oracle_sql()."""
    from . import analysis, cleaning, sequences, signals, storage

    return [cleaning, sequences, signals, analysis, storage]
