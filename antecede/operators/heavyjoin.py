"""Joins of a large table to a smaller one when some keys hold a large share of its rows.

Keys are counted, and a key with more than one part in ``SHARES`` of all rows is split into that many rows a part: its rows are dealt over
the parts by their hash, and the smaller side repeats its row for these parts only. At most ``SHARES`` keys can be so large, which
bounds the list that is broadcast. Every other key joins as usual, so nothing else is repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

SHARES = 200


def heavy_keys(counts: DataFrame) -> DataFrame:
    """(keys, parts) of the keys of (keys, n) that hold more than their share of all rows."""
    limit = counts.agg(F.greatest(F.ceil(F.sum("n") / SHARES), F.lit(1))).scalar()
    return counts.withColumn("parts", F.ceil(F.col("n") / limit).cast("int")).filter("parts > 1").drop("n")


def heavy_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``side`` on ``keys`` (inner or left). ``counts`` (keys, n) saves counting where it is known.

    A null key matches nothing; in a left join its rows are spread too."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    heavy = F.broadcast(heavy_keys(counts.select(*keys, "n")))
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    parts = F.coalesce("parts", F.when(absent, SHARES).otherwise(1))
    salted = rows.join(heavy, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("parts")
    repeated = side.join(heavy, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(repeated, [*keys, "_part"], how).drop("_part")
