"""Negative controls: score windows that cannot hold the cause, and compare grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.codes import KEPT_GRADES, WINDOW_DAYS
from antecede.functions.rounding import steady_round
from antecede.plans.score_causes import (
    best_per_type, documented_groups, score_windows, target_windows,
)

GRADES = ("confirmed", "reported", "pattern", "weak", "dropped")


def hash_number(seed: str, key: Column) -> Column:
    """A non-negative number drawn from a seeded hash of the key."""
    digest = F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def control_windows(targets: DataFrame, first_day: str, last_day: str, seed: str = "controls",
                    near: int = 60, far: int = 250) -> DataFrame:
    """Real, shuffled and future windows of every target.

    The shuffled window moves by ``near`` to ``far`` days either way, inside the given days."""
    day = F.col("event_date")
    draw = hash_number(seed, F.col("GlobalEventID"))
    shift = F.when(draw % 2 == 0, 1).otherwise(-1) * (
        near + F.floor(draw / 2) % (far - near + 1))
    moved = F.least(F.greatest(F.date_add(day, shift.cast("int")), F.lit(first_day).cast("date")),
                    F.lit(last_day).cast("date"))
    return (
        target_windows(targets, "real")
        .unionByName(target_windows(
            targets, "shuffled", F.date_sub(moved, WINDOW_DAYS), F.date_sub(moved, 1)))
        .unionByName(target_windows(
            targets, "future", F.date_add(day, 1), F.date_add(day, WINDOW_DAYS)))
    )


def scored_arms(events: DataFrame, targets: DataFrame, windows: DataFrame) -> DataFrame:
    """Recorded links count in the real arm only."""
    documented = documented_groups(targets, events).withColumn("arm", F.lit("real"))
    return best_per_type(score_windows(events, windows, documented))


def arm_summary(arms: DataFrame) -> DataFrame:
    """Per arm and grade: share, and per arm the kept rate and mean confidence."""
    kept = F.count_if(F.col("grade").isin(*KEPT_GRADES)) / F.count("*")
    return arms.groupBy("arm").agg(
        F.count("*").alias("pairs"),
        *[steady_round(F.count_if(F.col("grade") == g) / F.count("*"), 4).alias(g) for g in GRADES],
        steady_round(kept, 4).alias("kept_rate"),
        steady_round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def discrimination(summary: DataFrame) -> DataFrame:
    """Real over shuffled share of every grade; null where the shuffled share is 0 or there is none."""
    names = summary.sparkSession.createDataFrame([(g,) for g in GRADES], "grade string")
    long = names.join(summary.unpivot(["arm"], list(GRADES), "grade", "share"), "grade", "left")
    arm = lambda name: F.max(F.when(F.col("arm") == name, F.col("share")))
    # An arm without candidates has a share of 0, as a grade without any has.
    return long.groupBy("grade").agg(
        steady_round(F.try_divide(F.coalesce(arm("real"), F.lit(0.0)), arm("shuffled")), 2).alias("discrimination"))
