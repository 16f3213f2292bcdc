"""Registry of named queries: Spark plan + (optional) DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPS: dict[str, tuple[str, ...]] = {}


def register(name: str, ops: tuple[str, ...] | str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ops`` lists the SURVEY inventory ids the query exercises; ``oracle`` is the
    DuckDB SQL producing the same columns, or None for rows-only checks.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPS[name] = (ops,) if isinstance(ops, str) else tuple(ops)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
