"""Screening and dataset splits over articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from antecede.operators.events import has_url
from antecede.operators.ordering import with_running_total
from antecede.operators.similarity import duplicate_groups
from antecede.functions.urls import normalize_url
from antecede.session import checkpointed


def scope_observations(events: DataFrame, roots: list[str], place: str, first: int,
                       last: int) -> DataFrame:
    """Distinct in-scope observations with their URL key."""
    wanted = (
        F.col("EventRootCode").isin(roots) & (F.col("ActionGeo_CountryCode") == place)
        & F.col("day").between(first, last) & has_url())
    columns = ["GlobalEventID", "day", "EventCode", "EventRootCode", "ActionGeo_CountryCode",
               "SOURCEURL"]
    return events.filter(wanted).select(*columns).distinct().withColumn(
        "url_key", normalize_url(F.col("SOURCEURL"))).filter("url_key <> ''")


def split_names(before: Column, total: Column, test_end: Column, test: Column, dev: Column) -> Column:
    return F.when(before < test, "test").when(before - test_end < dev, "dev").otherwise("train")


def assign_splits(records: DataFrame, key: str, text: str, exact_fields: list[str],
                  pilot: DataFrame, seed: str, test_share: float, dev_share: float) -> DataFrame:
    """(key, component, split): whole duplicate groups go to pilot, test, dev or train.

    A group with an inspected pilot record is pilot. The rest fill test, then dev, then train
    in seeded hash order of their first record."""
    grouped = checkpointed(duplicate_groups(records, key, text, exact_fields))
    piloted = grouped.join(pilot.select(key), key, "left_semi").select("component").distinct()
    groups = grouped.join(piloted, "component", "left_anti").groupBy("component").agg(
        F.count("*").alias("n"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256)
    filled = checkpointed(with_running_total(groups, [order], F.col("n")))
    total = filled.agg(F.sum("n")).scalar()
    test, dev = F.bround(total * test_share), F.bround(total * dev_share)
    # Where the test split ends: groups are whole, so it may pass its target.
    test_end = filled.filter(F.col("before") < test).agg(
        F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0))).scalar()
    names = filled.select(
        "component", split_names(F.col("before"), total, test_end, test, dev).alias("split"))
    return grouped.join(names, "component", "left").withColumn(
        "split", F.coalesce("split", F.lit("pilot"))).select(key, "component", "split")
