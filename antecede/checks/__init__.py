"""Registered queries and the SQL each is compared with.

Every entry reads whole tables. The SQL side restates the same result for an independent
engine, built from the named common table expressions of ``base``.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CHECKS: dict[str, tuple[Query, str | None]] = {}
SUBJECTS = (
    "event_checks", "dashboard_checks", "scoring_checks", "url_checks", "text_checks",
    "review_checks", "mention_checks", "candidate_checks", "graph_checks", "evaluation_checks",
)


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"{name} registered twice")
        CHECKS[name] = (fn, sql)
        return fn

    return register


def load() -> dict[str, tuple[Query, str | None]]:
    for subject in SUBJECTS:
        if importlib.util.find_spec(f"{__name__}.{subject}"):
            importlib.import_module(f"{__name__}.{subject}")
    return CHECKS
