"""URL queue, URL status summaries and article samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.dates import date_of_day
from antecede.functions.rounding import steady_round
from antecede.functions.urls import hostname, is_alive, normalize_url, outlet
from antecede.operators.events import has_url
from antecede.operators.ordering import with_running_total


def url_queue(events: DataFrame) -> DataFrame:
    """One row per URL key, with the first source URL in text order."""
    urls = events.filter(has_url()).select(F.trim("SOURCEURL").alias("source_url"))
    return urls.groupBy(normalize_url(F.col("source_url")).alias("url_key")).agg(
        F.min("source_url").alias("source_url")).filter("url_key <> ''")


def queue_summary(events: DataFrame) -> DataFrame:
    """Distinct URLs, keys, URLs without a key, and URLs that shared a key."""
    urls = events.filter(has_url()).groupBy("SOURCEURL").agg(F.lit(1).alias("one")).select(
        normalize_url(F.col("SOURCEURL")).alias("url_key"))
    # Keys are counted by aggregating twice, so no task holds them all.
    keys = urls.groupBy("url_key").agg(F.count("*").alias("n"))
    real = F.col("url_key") != ""
    return keys.agg(
        F.sum("n").alias("source_url_rows"), F.count_if(real).alias("unique_url_keys"),
        F.sum(F.when(real, 0).otherwise(F.col("n"))).alias("invalid_urls"),
        F.sum(F.when(real, F.col("n") - 1).otherwise(0)).alias("normalization_collisions"),
    )


def first_event_day(events: DataFrame) -> DataFrame:
    """The earliest event day per URL key."""
    return events.filter(has_url()).groupBy(normalize_url(F.col("SOURCEURL")).alias("url_key")).agg(
        date_of_day(F.min("day")).alias("event_day")).filter("url_key <> ''")


def status_summary(events: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """URL counts per status (or reason, where no status was had), with live and event rows.

    ``cache`` has (url, alive, status, reason), one row per URL. Where URLs were fetched more than once, both sides name the
    fetch by the column ``key`` instead, and a URL counts once under each of its outcomes."""
    urls = events.withColumn("url", F.col("SOURCEURL")).groupBy("url", *{key} - {"url"}).agg(F.count("*").alias("event_rows"))
    label = F.when(F.col("alive").isNull(), "missing-result").otherwise(
        F.coalesce(F.col("status").cast("string"), "reason", F.lit("unknown")))
    live_rows = F.when(F.col("alive"), F.col("event_rows")).otherwise(0)
    per_url = urls.join(cache.select(key, "alive", "status", "reason"), key, "left").groupBy(label.alias("outcome"), "url").agg(
        F.max("alive").alias("alive"), F.sum("event_rows").alias("event_rows"), F.sum(live_rows).alias("live_rows"))
    return per_url.groupBy("outcome").agg(
        F.count("*").alias("urls"), F.count_if("alive").alias("live_urls"),
        F.sum("event_rows").alias("input_rows"), F.sum("live_rows").alias("output_rows"),
    )


def url_cache(entries: DataFrame) -> DataFrame:
    """Normalise status-cache entries: (url, legacy boolean, status, reason, alive flag).

    An old entry is a bare boolean; it keeps its verdict and gets no status."""
    old = F.col("legacy").isNotNull()
    return entries.filter(old | F.col("alive").isNotNull()).select(
        "url", F.coalesce("legacy", "alive").alias("alive"),
        F.when(~old, F.col("status")).alias("status"),
        F.when(old, "legacy-cache").otherwise(F.col("reason")).alias("reason"),
    )


def checked(log: DataFrame) -> DataFrame:
    return log.withColumn("alive", is_alive(F.col("status")))


def fetch_summary(records: DataFrame, corpus_hosts: DataFrame, top_hosts: int = 10) -> DataFrame:
    """Extraction success overall, for the largest hosts and for the rest.

    ``records`` has (host, status, language, paywalled, complete_html, text_length);
    ``corpus_hosts`` has (host, urls). The list of largest hosts is ``top_hosts`` rows."""
    largest = corpus_hosts.orderBy(F.desc("urls"), "host").limit(top_hosts).select(
        "host", F.lit(True).alias("top"))
    rows = records.join(F.broadcast(largest), "host", "left").withColumn(
        "top", F.coalesce("top", F.lit(False)))
    good = F.col("status") == "extracted"
    rate = lambda part: steady_round(F.try_divide(
        F.count_if(good & part), F.count_if(part)), 4)
    share = lambda c: steady_round(F.count_if(c) / F.count("*"), 4)
    total = rows.agg(
        F.count("*").alias("sample_size"), rate(F.lit(True)).alias("success_rate"),
        rate(F.col("top")).alias("top_hosts_rate"), rate(~F.col("top")).alias("long_tail_rate"),
        share(F.col("paywalled")).alias("paywall_share"),
        share(F.col("complete_html")).alias("complete_html_share"),
        F.count_if(good).alias("extracted"),
    )
    # The upper median comes from a length histogram with running totals over range partitions.
    lengths = records.filter(good).groupBy("text_length").agg(F.count("*").alias("n"))
    half = F.floor(lengths.agg(F.sum("n")).scalar() / 2)
    median = with_running_total(lengths, [F.col("text_length")], F.col("n")).filter(
        F.col("before") + F.col("n") > half).agg(F.min("text_length"))
    return total.withColumn("median_text_length", median.scalar())


def by_host_round_robin(urls: DataFrame, size: int) -> DataFrame:
    """Round-robin across hosts, so one prolific outlet cannot fill a sample.

    No host can place more than ``size`` URLs, so each host's list is cut to its ``size``
    first URLs before the final order."""
    host = hostname(F.col("url_key"))
    turn = Window.partitionBy("host").orderBy("url_key")
    return (
        urls.withColumn("host", host).filter("host <> ''")
        .withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= size)
        .orderBy("turn", "host").limit(size)
    )


def hash_order(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def seeded_sample(rows: DataFrame, key: str, seed: str, size: int,
                  taken: DataFrame | None = None) -> DataFrame:
    """The first ``size`` rows in seeded hash order; a larger size extends the sample."""
    free = rows if taken is None else rows.join(taken.select(key), key, "left_anti")
    return free.orderBy(hash_order(seed, F.col(key)), key).limit(size)


def status_sample(articles: DataFrame, statuses: list[str], size: int) -> DataFrame:
    """An equal share per status in hash order, topped up from the rest to ``size``."""
    share = -(-size // len(statuses))
    order = F.md5("url_key")
    turn = Window.partitionBy("status").orderBy(order, "document_id")
    ordinal = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    # Both parts are cut before they meet: at most ``share`` rows per status, ``size`` others.
    first = (
        articles.filter(F.col("status").isin(statuses))
        .withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= share)
        .drop("turn").withColumn("stage", ordinal.cast("bigint"))
    )
    rest = (
        articles.join(first.select("document_id"), "document_id", "left_anti")
        .orderBy(order, "document_id").limit(size)
        .withColumn("stage", F.lit(len(statuses) + 1).cast("bigint"))
    )
    return first.unionByName(rest).orderBy("stage", order, "document_id").limit(size)


def group_sources(events: DataFrame, stored: DataFrame, keep: int = 12) -> DataFrame:
    """Source URLs behind each stored event: all of its (day, code, place) group when it is
    a cause, else its own. At most ``keep`` in URL order, with outlet.

    ``stored`` has (GlobalEventID, is_cause)."""
    key = ["day", "EventRootCode", "ActionGeo_CountryCode"]
    # Cut each group to its first URLs before the join: they are all any event can show.
    turn = Window.partitionBy(*key).orderBy("SOURCEURL")
    group_urls = (
        events.filter(has_url()).select(*key, "SOURCEURL").distinct()
        .withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= keep)
    )
    placed = events.join(stored, "GlobalEventID")
    causes = placed.filter("is_cause").select("GlobalEventID", *key).join(group_urls, key)
    own = placed.filter(~F.col("is_cause") & has_url()).select("GlobalEventID", "SOURCEURL",
                                                               F.lit(1).alias("turn"))
    return causes.select("GlobalEventID", "SOURCEURL", "turn").unionByName(own).withColumn(
        "domain", outlet(F.col("SOURCEURL")))
