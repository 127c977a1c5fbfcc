"""Registry of the queries over the given tables: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with the SQL that gives the same rows."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    """The modules register their queries when they are first imported."""
    from . import q_contracts, q_extra, q_joins, q_metrics, q_models, q_priors, q_sampling, q_sources, q_space  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
