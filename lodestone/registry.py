"""Names of the queries, each tagged with the inventory rows that it covers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_IDS: dict[str, tuple[str, ...]] = {}


def register(name: str, ids: tuple[str, ...], query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name], _IDS[name] = query, ids
    if sql:
        _SQL[name] = sql


def _load() -> None:
    import lodestone.queries.all  # noqa: F401  registers on first use


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def inventory() -> dict[str, tuple[str, ...]]:
    _load()
    return dict(_IDS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["bm25_topk"](spark, sf_dir)
