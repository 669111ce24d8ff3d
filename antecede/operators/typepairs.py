"""Which event types follow which, over unusually busy days.

The (country, code, day) table is small whatever the event count, and everything here
reads that table; countries are handled together by keeping the country in every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from antecede.functions.codes import SPIKE_PERCENTILE, WINDOW_DAYS, or_default
from antecede.functions.rounding import steady_round


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(
        F.col("ActionGeo_CountryCode").alias("cc"),
        or_default(F.col("EventRootCode"), "00").alias("rc"),
        F.col("event_date").alias("d"),
    ).agg(F.count("*").alias("n"))


def spike_days(events: DataFrame) -> DataFrame:
    """Days on which a code is strictly above its own 75th percentile in a country."""
    own = Window.partitionBy("cc", "rc")
    return (
        daily_counts(events)
        .withColumn("threshold", F.percentile("n", SPIKE_PERCENTILE).over(own))
        .filter(F.col("n") > F.col("threshold"))
    )


def spike_pairs(spikes: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Cause and effect spike days at most ``window_days`` apart: an interval join turned
    into an equi join by listing the days a cause day reaches."""
    day = F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", window_days)))
    causes = spikes.select("cc", F.col("rc").alias("crc"), F.col("d").alias("cd"), day.alias("ed"))
    effects = spikes.select("cc", F.col("rc").alias("erc"), F.col("d").alias("ed"))
    return causes.join(effects, ["cc", "ed"])


def type_pair_matrix(events: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Sufficiency, necessity and lift per (country, cause code, effect code)."""
    spikes = spike_days(events)
    pairs = spike_pairs(spikes, window_days).groupBy("cc", "crc", "erc").agg(
        F.countDistinct("cd").alias("cause_hits"), F.countDistinct("ed").alias("effect_hits"))
    totals = spikes.groupBy("cc", "rc").agg(F.countDistinct("d").alias("spike_days"))
    span = spikes.groupBy("cc").agg(F.countDistinct("d").alias("total_days"))
    cause = totals.select("cc", F.col("rc").alias("crc"), F.col("spike_days").alias("cause_days"))
    effect = totals.select("cc", F.col("rc").alias("erc"), F.col("spike_days").alias("effect_days"))
    suff = F.col("cause_hits") / F.col("cause_days")
    nec = F.col("effect_hits") / F.col("effect_days")
    lift = suff / (F.col("effect_days") / F.col("total_days"))
    return (
        pairs.join(cause, ["cc", "crc"]).join(effect, ["cc", "erc"]).join(span, "cc")
        .withColumns({
            "sufficiency": steady_round(suff, 4), "necessity": steady_round(nec, 4),
            "lift": steady_round(lift, 4),
        })
    )


def strongest_pairs(matrix: DataFrame, keep: int = 40) -> DataFrame:
    """Per country, the pairs of different types with the highest lift."""
    ranked = Window.partitionBy("cc").orderBy(F.desc("lift"), "crc", "erc")
    return (
        matrix.filter("crc <> erc").withColumn("place", F.row_number().over(ranked))
        .filter(F.col("place") <= keep)
    )
