"""Idempotent and append-only loads.

Each function takes the current table and an incoming batch and returns the rows to append,
so it works in a batch job and inside ``foreachBatch`` alike: replaying a batch after a lost
executor appends nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The current row of every key; ``max_by`` combines map-side, so hot keys are cheap."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*key).agg(last).select(*key, "row.*")


def new_rows(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is absent; one row per key within the batch."""
    return incoming.join(current.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def changed_rows(current: DataFrame, incoming: DataFrame, key: str,
                 tracked: Sequence[str]) -> DataFrame:
    """Incoming rows that are new or differ in a tracked field from the current row, with
    ``supersedes`` telling the two apart. Nulls compare as equal."""
    known = current.select(key, *[F.col(c).alias(f"old_{c}") for c in tracked],
                           F.lit(True).alias("known"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in tracked])
    return (
        incoming.join(known, key, "left")
        .filter(F.col("known").isNull() | ~same)
        .withColumn("supersedes", F.coalesce("known", F.lit(False)))
        .select(*incoming.columns, "supersedes")
    )
