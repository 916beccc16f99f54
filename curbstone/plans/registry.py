"""All registered queries of the service-request engine, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

FLAGSHIP = "flagship"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_PLANS = ("figures", "records", "lookups", "changes", "cleaning")


def add(name: str, query: Callable, sql: str | None = None) -> None:
    """Registers query(spark, sf_dir) under name; sql says the same to DuckDB on the tables of that folder."""
    if name in _QUERIES:
        raise ValueError(f"{name} is there already")
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _load() -> None:
    for p in _PLANS:
        import_module(f"curbstone.plans.{p}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
