"""The registry of core queries: a function of (spark, sf_dir), and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from tessella.plans import evaluation, graphs, reports, retrieval, routing, samples, stores, texts, vectors  # noqa: E402, F401
