"""Stable ids and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stable_id(prefix: str, key: Column) -> Column:
    """The prefix and the first 16 hex digits of the key's SHA-256."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(key.cast("string"), 256), 1, 16))


def claim_key(effect: Column, cause: Column) -> Column:
    return stable_id("cl", F.concat(effect.cast("string"), F.lit("<-"), cause.cast("string")))


def member_key(prefix: str, members: Column) -> Column:
    """An id from a cluster's sorted member ids."""
    return stable_id(prefix, F.array_join(F.array_sort(members), "|"))


def edge_key(source: Column, target: Column) -> Column:
    return stable_id("e", F.concat(source.cast("string"), F.lit("|"), target.cast("string")))


def content_version(rows: DataFrame) -> DataFrame:
    """One row with a version that depends on content alone, not on row order.

    Row hashes are summed, with their count, before the final hash: sums combine map-side
    where sorting every hash would pass the whole table through one task."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.agg(F.count("*").alias("rows"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", "s0", "s1", "s2", "s3"), 256).alias("version"))
