"""Trailing in-degree and precursor links.

Both read one table of (pair key, day) counts instead of a window or a self-join over
events. The frame ends the day before, so every event of a pair and day has the same
in-degree, and a busy pair is a few hundred day rows however many events it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from antecede.functions.codes import MAX_IN_DEGREE, WINDOW_DAYS, or_default
from antecede.functions.dates import date_of_day, day_number
from antecede.operators.heavyjoin import heavy_join
from antecede.session import checkpointed


def with_pair_key(events: DataFrame) -> DataFrame:
    """Add event_date, root_code and the unordered country-pair key with the root code."""
    def side(column: str):
        return F.coalesce(
            F.nullif(F.col(column), F.lit("")), F.col("ActionGeo_CountryCode"), F.lit("XX")
        )

    first, second = side("Actor1CountryCode"), side("Actor2CountryCode")
    root = or_default(F.col("EventRootCode"), "00")
    dated = events if "event_date" in events.columns else events.withColumn(
        "event_date", date_of_day(F.col("day")))
    return dated.withColumn("root_code", root).withColumn(
        "pair_key", F.concat_ws("|", F.least(first, second), F.greatest(first, second), root)
    )


def pair_days(keyed: DataFrame, window_days: int = WINDOW_DAYS,
              max_in_degree: int = MAX_IN_DEGREE) -> DataFrame:
    """One row per pair key and day: the in-degree of its events and their precursors.

    ``precursors`` is complete wherever the in-degree is at most ``max_in_degree``: then
    no day in the frame holds more rows than that, and only such days contribute ids.
    """
    counts = keyed.groupBy("pair_key", "event_date").agg(
        F.count("*").alias("n"),
        F.min("GlobalEventID").alias("low_id"),
        F.max("GlobalEventID").alias("high_id"),
    )
    if max_in_degree <= 2:
        # The smallest and largest id are all the ids of a day of one or two events.
        days = counts.withColumn(
            "ids",
            F.when(F.col("n") <= max_in_degree,
                   F.array_distinct(F.array("low_id", "high_id"))),
        )
    else:
        few = counts.filter(F.col("n") <= max_in_degree).select("pair_key", "event_date")
        ids = (
            keyed.join(few, ["pair_key", "event_date"], "left_semi")
            .groupBy("pair_key", "event_date")
            .agg(F.collect_set("GlobalEventID").alias("ids"))
        )
        days = counts.join(ids, ["pair_key", "event_date"], "left")
    frame = (
        Window.partitionBy("pair_key")
        .orderBy(day_number(F.col("event_date")))
        .rangeBetween(-window_days, -1)
    )
    return days.select(
        "pair_key", "event_date", "n",
        F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("causal_in_degree"),
        F.sort_array(F.flatten(F.collect_list("ids").over(frame))).alias("precursors"),
    )


def trailing_in_degree(events: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Events plus ``causal_in_degree``: same-key events 7 to 1 days before."""
    keyed = with_pair_key(events)
    days = checkpointed(pair_days(keyed, window_days).select("pair_key", "event_date", "n", "causal_in_degree"))
    return heavy_join(keyed, days.drop("n"), ["pair_key", "event_date"], counts=days)


def low_in_degree(events: DataFrame, window_days: int = WINDOW_DAYS,
                  max_in_degree: int = MAX_IN_DEGREE) -> DataFrame:
    """The served table: events with few precursors, and the list of them.

    Busy pairs leave the day table before the join, so the side that could be skewed has
    nothing to meet there.
    """
    keyed = with_pair_key(events)
    days = pair_days(keyed, window_days, max_in_degree).filter(
        F.col("causal_in_degree") <= max_in_degree
    )
    return (
        keyed.join(days.drop("n"), ["pair_key", "event_date"])
        .withColumn("precursor_ids", F.array_join("precursors", ","))
    )


def degree_histogram(events: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """In-degree buckets 0..4 and 5+, with percentages; never joins back to events."""
    days = pair_days(with_pair_key(events), window_days)
    bucket = F.when(F.col("causal_in_degree") >= 5, "5+").otherwise(
        F.col("causal_in_degree").cast("string"))
    counts = days.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("cnt"))
    total = Window.partitionBy()
    return counts.withColumn("pct", 100.0 * F.col("cnt") / F.sum("cnt").over(total))


def removal_counts(events: DataFrame, max_in_degree: int = MAX_IN_DEGREE) -> DataFrame:
    """How many events the low in-degree filter keeps and removes."""
    days = pair_days(with_pair_key(events))
    kept = F.sum(F.when(F.col("causal_in_degree") <= max_in_degree, F.col("n")).otherwise(0))
    return days.agg(F.sum("n").alias("total"), kept.alias("kept")).withColumn(
        "removed", F.col("total") - F.col("kept"))


def precursor_links(served: DataFrame) -> DataFrame:
    """One row per (event, precursor) of the served table."""
    return served.select(
        F.col("GlobalEventID").alias("later_id"), F.explode("precursors").alias("earlier_id")
    )
