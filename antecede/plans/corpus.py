"""Corpus build: country and root-code filters, live URLs, annotation units."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from antecede.functions.urls import normalize_url
from antecede.operators.events import annotation_units, in_country, only_live, with_target_roots
from antecede.operators.urlset import queue_summary, url_queue


def corpus_units(events: DataFrame, country: str, url_status: DataFrame) -> DataFrame:
    targets = with_target_roots(in_country(events, country))
    return annotation_units(only_live(targets, url_status))


def corpus_build(events: DataFrame, country: str, url_status: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, queue, summary) of a corpus: annotation units with their URL key, the URLs to fetch for them, each key once,
    and how many URLs had no key or shared one. Units without a usable URL have no key."""
    units = corpus_units(events, country, url_status)
    wanted = units.select(F.col("source_url").alias("SOURCEURL"))
    keyed = units.withColumn("url_key", F.nullif(normalize_url(F.col("source_url")), F.lit("")))
    return keyed, url_queue(wanted), queue_summary(wanted)
