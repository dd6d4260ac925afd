"""Named queries: each entry is a Spark plan over the test tables plus, where SQL can express it,
the DuckDB oracle SQL computing the same result.

Query functions take ``(spark, sf_dir)`` and return a DataFrame; they only plan (no actions),
except where a bounded dimension is measured before a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle (None: no SQL form)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the plan modules registers their queries.
    from pricelake.plans import ingest_runs, ingest_side, ops_side, read_side, text_side, vector_side  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
