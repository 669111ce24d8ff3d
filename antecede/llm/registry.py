"""The queries of this package, with the SQL each is compared with where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
MODULES = ("native_queries", "model_queries", "pair_queries", "file_queries", "audit_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = (fn, sql)
        return fn

    return register


def load() -> dict[str, tuple[Query, str | None]]:
    for module in MODULES:
        importlib.import_module(f"antecede.llm.{module}")
    return QUERIES
