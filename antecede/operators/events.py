"""Filters, projections and manifests over the event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.codes import (
    FIPS_NAME, QUAD_LABEL, ROOT_LABEL, TARGET_ROOTS, COUNTRY_NAME, lookup, or_default,
    padded_root,
)

EVENT_COLUMNS = (
    "day", "datetime", "GlobalEventID", "EventCode", "EventRootCode", "QuadClass",
    "GoldsteinScale", "Actor1Name", "Actor1CountryCode", "Actor2Name", "Actor2CountryCode",
    "ActionGeo_CountryCode", "SOURCEURL",
)


def in_country(events: DataFrame, code: str) -> DataFrame:
    return events.filter(F.col("ActionGeo_CountryCode") == code)


def touching_countries(events: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Events whose location or either actor is in the code list, as event columns."""
    wanted = list(codes)
    keep = (
        F.col("ActionGeo_CountryCode").isin(wanted)
        | F.col("Actor1CountryCode").isin(wanted)
        | F.col("Actor2CountryCode").isin(wanted)
    )
    return events.filter(keep).select(*[c for c in EVENT_COLUMNS if c in events.columns])


def with_target_roots(events: DataFrame, roots: Sequence[str] = TARGET_ROOTS) -> DataFrame:
    return events.filter(F.col("EventRootCode").isin(list(roots)))


def country_condition(countries: str = "", column: str = "ActionGeo_CountryCode") -> Column:
    """A comma list of codes; empty means the ten default countries."""
    codes = [c.strip() for c in countries.split(",") if c.strip()] or list(FIPS_NAME)
    return F.col(column).isin(codes)


def quad_condition(quad: str = "") -> Column:
    return F.col("QuadClass") == quad if quad else F.lit(True)


def day_condition(first: int = 19790101, last: int = 20991231) -> Column:
    return F.col("day").between(first, last)


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring test in which ``%`` and ``_`` are plain characters."""
    return F.contains(F.upper(column), F.upper(F.lit(text)))


def actor_condition(search: str = "") -> Column:
    if not search:
        return F.lit(True)
    return F.coalesce(
        contains_text(F.col("Actor1Name"), search) | contains_text(F.col("Actor2Name"), search),
        F.lit(False),
    )


def has_url(column: str = "SOURCEURL") -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def only_live(events: DataFrame, url_status: DataFrame) -> DataFrame:
    """Events whose source URL is alive; ``url_status`` has (url, alive)."""
    live = url_status.filter("alive").select(F.col("url").alias("SOURCEURL"))
    return events.join(live, "SOURCEURL", "left_semi")


def manifest(events: DataFrame, code: str = "EventRootCode") -> DataFrame:
    """Rows, first and last day, in total and per code, from one aggregation."""
    return (
        events.rollup(code)
        .agg(F.count("*").alias("rows"), F.min("day").alias("min_day"),
             F.max("day").alias("max_day"))
        .withColumn(code, F.coalesce(F.col(code), F.lit("ALL")))
    )


def columns_preserved(before: DataFrame, after: DataFrame) -> bool:
    return before.columns == after.columns


def viewer_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("GlobalEventID").cast("string").alias("id"),
        F.col("day").cast("string").alias("date"),
        F.col("EventCode").alias("event_code"),
        F.col("EventRootCode").alias("root"),
        F.col("GoldsteinScale").alias("goldstein"),
        F.col("Actor1Name").alias("actor1"),
        F.col("Actor2Name").alias("actor2"),
        F.col("SOURCEURL").alias("source_url"),
    )


def annotation_units(events: DataFrame) -> DataFrame:
    """One unit per event with a URL; missing codes and ids read ``unknown``."""
    event_id = F.coalesce(F.col("GlobalEventID").cast("string"), F.lit("unknown"))
    return events.filter(has_url()).select(
        F.concat(F.lit("event-"), event_id).alias("unit_id"),
        event_id.alias("event_id"),
        F.col("SOURCEURL").alias("source_url"),
        F.coalesce(F.col("EventCode").cast("string"), F.lit("unknown")).alias("event_code"),
        F.col("EventRootCode").cast("string").alias("root"),
        F.col("day").cast("string").alias("day"),
        F.col("GoldsteinScale").alias("goldstein"),
        F.col("Actor1Name").alias("actor1"),
        F.col("Actor1CountryCode").alias("actor1_country"),
        F.col("Actor2Name").alias("actor2"),
        F.col("Actor2CountryCode").alias("actor2_country"),
    )


def decoded(events: DataFrame) -> DataFrame:
    """Code labels beside the codes; unknown codes label themselves."""
    root = padded_root(F.col("EventRootCode"))
    place = F.col("ActionGeo_CountryCode")
    return events.withColumns({
        "root_label": lookup(ROOT_LABEL, root, root),
        "quad_label": lookup(QUAD_LABEL, F.col("QuadClass"), F.col("QuadClass")),
        "country_name": lookup(COUNTRY_NAME, place, place),
    })


def property_graph(served: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables of the event graph, one DataFrame per label."""
    text = lambda c: or_default(F.col(c), "")
    event_id = F.col("GlobalEventID").cast("string")
    countries = served.select(
        F.explode(F.array("Actor1CountryCode", "Actor2CountryCode", "ActionGeo_CountryCode"))
        .alias("code")
    ).filter("code <> ''").distinct()
    actors = served.select(F.explode(F.array("Actor1Name", "Actor2Name")).alias("name")).filter(
        "name <> ''").distinct()

    def edges(column: str) -> DataFrame:
        return served.filter(text(column) != "").select(
            event_id.alias("event_id"), F.col(column).alias("target")).distinct()

    return {
        "Event": served.select(
            event_id.alias("id"), F.col("day").cast("string").alias("date"),
            text("EventCode").alias("eventCode"), text("EventRootCode").alias("rootCode"),
            lookup(QUAD_LABEL, F.col("QuadClass"), F.col("QuadClass")).alias("quadClass"),
            F.coalesce("GoldsteinScale", F.lit(0.0)).alias("goldstein"),
            F.col("causal_in_degree").cast("int").alias("inDegree"),
        ).dropDuplicates(["id"]),
        "Country": countries.withColumn(
            "name", lookup(COUNTRY_NAME, F.col("code"), F.col("code"))),
        "Actor": actors,
        "Article": served.filter(has_url()).select(F.col("SOURCEURL").alias("url")).distinct(),
        "OCCURRED_IN": edges("ActionGeo_CountryCode"),
        "ACTOR1_IN": edges("Actor1Name"),
        "ACTOR2_IN": edges("Actor2Name"),
        "MENTIONED_IN": edges("SOURCEURL"),
        "PRECEDED_BY": served.select(
            event_id.alias("event_id"), F.explode(F.split("precursor_ids", ",")).alias("target")
        ).filter("target <> ''").distinct(),
    }
