"""Global positions and running totals without a single-task window.

Rows are range-partitioned on the order, each partition is ranked on its own, and the
partition totals (one row per partition) supply the offsets. The order must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.session import checkpointed


def _ranged(rows: DataFrame, order: Sequence[Column], value: Column) -> tuple[DataFrame, DataFrame]:
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    parts = checkpointed(
        rows.withColumns({**keys, "_value": value}).repartitionByRange(*keys)
        .withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.sum("_value").alias("_total")).select(
        "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    # One row per partition: the partition count bounds the broadcast.
    return parts, F.broadcast(offsets)


def with_position(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 1-based place of each row in the global order."""
    parts, offsets = _ranged(rows, order, F.lit(1))
    keys = [f"_o{i}" for i in range(len(order))]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.join(offsets, "_part").withColumn(name, place + F.col("_offset")).drop(
        *keys, "_value", "_part", "_offset")


def with_running_total(rows: DataFrame, order: Sequence[Column], value: Column,
                       name: str = "before") -> DataFrame:
    """Add the total of ``value`` over all rows strictly before each row."""
    parts, offsets = _ranged(rows, order, value)
    keys = [f"_o{i}" for i in range(len(order))]
    frame = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_value").over(frame), F.lit(0)) + F.col("_offset")
    return parts.join(offsets, "_part").withColumn(name, total).drop(
        *keys, "_value", "_part", "_offset")
