"""Registered queries and their SQL, by name."""

from __future__ import annotations

from functools import wraps

from vecspark.sources.shared import ship

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Decorator: registers a function of (spark, sf_dir) with its oracle SQL. Executors get the package before it runs."""

    def put(f):
        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
