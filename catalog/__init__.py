"""The registered queries: each runs library operators on the supplied tables.

Every query is a Spark callable ``(spark, sf_dir) -> DataFrame``; most carry SQL giving
the same rows on the same tables, written independently of the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = ["joins", "shaping", "measures", "resampling", "pixels", "objects", "spatial", "jobs"]


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL when there is any."""

    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"catalog.{module}")
