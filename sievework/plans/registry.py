"""Every registered query of the library's own operators, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from sievework.plans import audits, curation, discovery, evidence, exchange, graph, lists, mining, scalars, serving, site, streams  # noqa: E402, F401  they register themselves
