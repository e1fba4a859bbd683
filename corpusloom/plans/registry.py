"""The queries by name, with their DuckDB SQL."""

from __future__ import annotations

from corpusloom.session import ship

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, and the SQL that gives the same."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from corpusloom.plans import evaluation, explain, features, fitted, models, prep  # noqa: F401


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)
