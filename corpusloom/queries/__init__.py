"""Queries over the driver's tables with their SQL counterparts: QUERIES of each module maps a name to (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable


def _pairs() -> dict[str, tuple[Callable, str | None]]:
    from . import assembly, features, reading, spaces, stores, streams, tables, text, udf

    return reading.QUERIES | text.QUERIES | tables.QUERIES | udf.QUERIES | features.QUERIES | assembly.QUERIES | stores.QUERIES | streams.QUERIES | spaces.QUERIES


def all_queries() -> dict[str, Callable]:
    return {name: query for name, (query, _) in _pairs().items()}


def all_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _pairs().items() if sql}
