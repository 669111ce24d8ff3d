"""Dashboard aggregates over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.codes import CONFLICT_QUADS
from antecede.functions.dates import month_label, month_of_day
from antecede.operators.events import (
    actor_condition, country_condition, quad_condition,
)


def is_conflict() -> Column:
    return F.col("QuadClass").isin(*CONFLICT_QUADS)


def both_actors() -> Column:
    return (F.col("Actor1CountryCode") != "") & (F.col("Actor2CountryCode") != "")


def overall(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total_events"), F.min("day").alias("date_from"),
        F.max("day").alias("date_to"),
        F.countDistinct("ActionGeo_CountryCode").alias("countries"),
    )


def country_nodes(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("ActionGeo_CountryCode").alias("cc")).agg(
        F.count("*").alias("n"),
        F.avg("GoldsteinScale").alias("avg_g"),
        F.count_if(is_conflict()).alias("n_conflict"),
    ).withColumn("conflict_ratio", F.col("n_conflict") / F.greatest("n", F.lit(1)))


def country_pairs(events: DataFrame, min_events: int = 5) -> DataFrame:
    """Directed country pairs with more than ``min_events`` events, their most common
    (quad class, root code) and two mean Goldstein values: the unweighted mean of the
    group means, and the mean over events."""
    pair = ["c1", "c2"]
    groups = events.filter(both_actors()).groupBy(
        F.col("Actor1CountryCode").alias("c1"), F.col("Actor2CountryCode").alias("c2"),
        F.col("QuadClass").alias("q"), F.col("EventRootCode").alias("rc"),
    ).agg(F.count("*").alias("n"), F.avg("GoldsteinScale").alias("avg_g"))
    # The most common group: n descending, then code and quad class ascending.
    lead = F.min(F.struct((-F.col("n")).alias("k"), "rc", "q"))
    return groups.groupBy(*pair).agg(
        lead.alias("lead"),
        F.sum("n").alias("total_n"),
        F.avg("avg_g").alias("pair_avg_g"),
        (F.sum(F.col("avg_g") * F.col("n")) / F.sum("n")).alias("weighted_avg_g"),
    ).filter(F.col("total_n") > min_events).select(
        *pair, F.col("lead.q").alias("dominant_q"), F.col("lead.rc").alias("dominant_rc"),
        "total_n", "pair_avg_g", "weighted_avg_g",
    )


def edge_stats(events: DataFrame) -> DataFrame:
    """Per (actor country, root code): totals, first and last day, conflict and cause share."""
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return events.groupBy("Actor1CountryCode", "EventRootCode").agg(
        F.count("*").alias("total"), F.avg("GoldsteinScale").alias("avg_goldstein"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        share(is_conflict()).alias("conflict_pct"),
        share(F.col("causal_in_degree") > 0).alias("causal_pct"),
    )


def usual_causes(events: DataFrame, keep: int = 4) -> DataFrame:
    """Per (place, root code): the commonest other codes of uncaused events in the same
    months. Counts are taken per (place, month, code) before the join."""
    month = month_of_day(F.col("day")).alias("month")
    place = F.col("ActionGeo_CountryCode").alias("cc")
    months = events.select(place, F.col("EventRootCode").alias("rc"), month).distinct()
    causes = events.filter((F.col("causal_in_degree") == 0) & (F.col("EventRootCode") != "")).groupBy(
        place, month, F.col("EventRootCode").alias("cause_rc")).agg(F.count("*").alias("n"))
    ranked = Window.partitionBy("cc", "rc").orderBy(F.desc("n"), "cause_rc")
    return (
        months.join(causes, ["cc", "month"]).filter("cause_rc <> rc")
        .groupBy("cc", "rc", "cause_rc").agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= keep)
    )


def monthly_frequency(events: DataFrame) -> DataFrame:
    month = month_of_day(F.col("day"))
    return events.groupBy("EventRootCode", "ActionGeo_CountryCode", month.alias("month_no")).agg(
        F.count("*").alias("n")).withColumn("month", month_label(F.col("month_no"))).drop("month_no")


def timeline(events: DataFrame, country: str = "", quad: str = "") -> DataFrame:
    """Month by quad-class counts and the count-weighted Goldstein trend, in one pass."""
    kept = events.filter(country_condition(country) & quad_condition(quad))
    count_of = lambda q: F.count_if(F.col("QuadClass") == q).alias(f"q{q}")
    return kept.groupBy(month_of_day(F.col("day")).alias("month_no")).agg(
        *[count_of(q) for q in "1234"], F.avg("GoldsteinScale").alias("goldstein_trend"),
    ).withColumn("month", month_label(F.col("month_no"))).drop("month_no")


def country_profiles(events: DataFrame, country: str = "") -> DataFrame:
    """Quad breakdown, conflict ratio and monthly trend per country, all from one
    (country, month) aggregation."""
    count_of = lambda q: F.count_if(F.col("QuadClass") == q).alias(f"q{q}")
    months = events.filter(country_condition(country)).groupBy(
        F.col("ActionGeo_CountryCode").alias("code"), month_of_day(F.col("day")).alias("month")
    ).agg(F.count("*").alias("n"), F.sum("GoldsteinScale").alias("g"), *[count_of(q) for q in "1234"])
    quads = [F.sum(f"q{q}").alias(f"q{q}") for q in "1234"]
    trend = F.transform(F.sort_array(F.collect_list(F.struct("month", "n"))), lambda s: s["n"])
    return months.groupBy("code").agg(
        F.sum("n").alias("total_events"), (F.sum("g") / F.sum("n")).alias("avg_goldstein"),
        *quads, trend.alias("monthly_trend"),
    ).withColumn("conflict_ratio", (F.col("q3") + F.col("q4")) / F.col("total_events"))


def interaction_matrix(events: DataFrame) -> DataFrame:
    return events.filter(both_actors()).groupBy(
        F.col("Actor1CountryCode").alias("c1"), F.col("Actor2CountryCode").alias("c2")
    ).agg(F.count("*").alias("n"), F.avg("GoldsteinScale").alias("avg_g"))


def sample_events(events: DataFrame, root: str, source: str, target: str,
                  place: str, keep: int = 8) -> DataFrame:
    """The most extreme events of a code for a country pair or a place."""
    wanted = (F.col("EventRootCode") == root) & (
        ((F.col("Actor1CountryCode") == source) & (F.col("Actor2CountryCode") == target))
        | (F.col("ActionGeo_CountryCode") == place)
    )
    return events.filter(wanted).orderBy(
        F.abs("GoldsteinScale").desc(), F.desc("day"), F.desc("GlobalEventID")).limit(keep)


def explainable_seeds(served: DataFrame, place: str, after_day: int, keep: int = 12) -> DataFrame:
    """Events worth explaining: with precursors and a code, most extreme first."""
    wanted = (
        (F.col("ActionGeo_CountryCode") == place) & (F.col("EventRootCode") != "")
        & (F.col("precursor_ids") != "") & (F.col("day") > after_day)
    )
    return served.filter(wanted).orderBy(
        F.abs("GoldsteinScale").desc(), F.desc("day"), F.desc("GlobalEventID")).limit(keep)


def event_page(events: DataFrame, search: str = "", country: str = "", quad: str = "",
               page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered listing, and the one-row total."""
    kept = events.filter(
        country_condition(country) & quad_condition(quad) & actor_condition(search))
    rows = kept.orderBy(F.desc("day"), F.desc("GlobalEventID")).offset((page - 1) * size).limit(size)
    return rows, kept.agg(F.count("*").alias("total"))


def daily_seeds(served: DataFrame) -> DataFrame:
    """One seed per place, code and day: the most extreme event, smallest id on ties.

    ``min`` of a struct combines map-side, so a hot day never sorts in one task."""
    fields = ["GlobalEventID", "Actor1Name", "Actor2Name", "GoldsteinScale", "SOURCEURL"]
    first = F.min(F.struct((-F.abs("GoldsteinScale")).alias("rank"), *fields))
    return (
        served.filter("precursor_ids <> ''")
        .groupBy("ActionGeo_CountryCode", "EventRootCode", "day").agg(first.alias("s"))
        .select("ActionGeo_CountryCode", "EventRootCode", "day", *[f"s.{f}" for f in fields])
    )
