"""Event filters, keys, in-degree and precursor links."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import rounded, with_
from antecede.functions.codes import number_or, or_default
from antecede.functions.dates import date_of_day, month_label, month_of_day
from antecede.operators import events as E, precedence as P
from antecede.plans.causal_filter import causal_filter
from antecede.plans.corpus import corpus_build, corpus_units
from antecede.session import checkpointed
from antecede.sources.stand_ins import event_view
from antecede.sources.tables import in_codes, read_events


@check("a2_event_view", with_("ev", """
    SELECT GlobalEventID, day, EventCode, EventRootCode, QuadClass,
           round(GoldsteinScale, 9) AS GoldsteinScale, Actor1Name, Actor1CountryCode, Actor2Name,
           Actor2CountryCode, ActionGeo_CountryCode, SOURCEURL FROM ev"""))
def event_table(spark, folder):
    event_view(spark, folder).createOrReplaceTempView("coded_events")
    return rounded(spark.table("coded_events").drop("event_date"))


@check("a1_table_scan", """
    SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1""")
def table_scan(spark, folder):
    return read_events(spark, f"{folder}/events.parquet").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@check("a8_code_list_join", with_("ev", """
    SELECT GlobalEventID, EventRootCode FROM ev WHERE EventRootCode IN (
        SELECT EventRootCode FROM ev WHERE QuadClass = '4' OR QuadClass = '3')"""))
def code_list_join(spark, folder):
    events = event_view(spark, folder)
    codes = events.filter("QuadClass IN ('3', '4')").select(F.col("EventRootCode").alias("code")).distinct()
    return in_codes(events, codes, "EventRootCode").select("GlobalEventID", "EventRootCode")


@check("a6_json_export", with_("ev", """
    SELECT GlobalEventID, '{"id":' || GlobalEventID || ',"root":"' || EventRootCode || '","url":"' || SOURCEURL || '"}' AS record
    FROM ev"""))
def json_export(spark, folder):
    events = event_view(spark, folder)
    record = F.struct(F.col("GlobalEventID").alias("id"), F.col("EventRootCode").alias("root"), F.col("SOURCEURL").alias("url"))
    return events.select("GlobalEventID", F.to_json(record).alias("record"))


@check("a10_dataset_manifest", with_("ev", """
    SELECT coalesce(EventRootCode, 'ALL') AS EventRootCode, count(*) AS rows,
           min(day) AS min_day, max(day) AS max_day
    FROM ev GROUP BY ROLLUP (EventRootCode)"""))
def dataset_manifest(spark, folder):
    return E.manifest(event_view(spark, folder))


@check("a12_property_graph", with_("served", """
    SELECT label, count(*) AS n, min(k) AS first_key, max(k) AS last_key FROM (
        SELECT 'Event' AS label, CAST(GlobalEventID AS VARCHAR) AS k FROM served
        UNION ALL SELECT 'Country', c FROM (
            SELECT DISTINCT unnest([Actor1CountryCode, Actor2CountryCode, ActionGeo_CountryCode]) AS c
            FROM served) WHERE c <> ''
        UNION ALL SELECT 'Actor', c FROM (
            SELECT DISTINCT unnest([Actor1Name, Actor2Name]) AS c FROM served) WHERE c <> ''
        UNION ALL SELECT DISTINCT 'Article', SOURCEURL FROM served
        UNION ALL SELECT 'OCCURRED_IN', GlobalEventID || '>' || ActionGeo_CountryCode FROM served
        UNION ALL SELECT 'ACTOR1_IN', GlobalEventID || '>' || Actor1Name FROM served
            WHERE Actor1Name <> ''
        UNION ALL SELECT 'ACTOR2_IN', GlobalEventID || '>' || Actor2Name FROM served
        UNION ALL SELECT 'MENTIONED_IN', GlobalEventID || '>' || SOURCEURL FROM served
        UNION ALL SELECT 'PRECEDED_BY', later_id || '>' || earlier_id FROM links)
    GROUP BY label"""))
def property_graph(spark, folder):
    tables = E.property_graph(P.low_in_degree(event_view(spark, folder)))
    keyed = None
    for label, df in tables.items():
        key = F.concat_ws(">", "event_id", "target") if "target" in df.columns else F.col(df.columns[0])
        part = df.select(F.lit(label).alias("label"), key.alias("k"))
        keyed = part if keyed is None else keyed.unionByName(part)
    return keyed.groupBy("label").agg(
        F.count("*").alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@check("b1_country_universe", with_("ev", """
    SELECT GlobalEventID, day, SOURCEURL FROM ev WHERE ActionGeo_CountryCode = 'G3'"""))
def country_universe(spark, folder):
    return E.in_country(event_view(spark, folder), "G3").select("GlobalEventID", "day", "SOURCEURL")


@check("b2_any_country_column", with_("ev", """
    SELECT day, GlobalEventID, EventCode, EventRootCode, QuadClass,
           round(GoldsteinScale, 9) AS GoldsteinScale, Actor1Name, Actor1CountryCode, Actor2Name,
           Actor2CountryCode, ActionGeo_CountryCode, SOURCEURL FROM ev
    WHERE ActionGeo_CountryCode IN ('G1', 'C7', 'C12') OR Actor1CountryCode IN ('G1', 'C7', 'C12')
       OR Actor2CountryCode IN ('G1', 'C7', 'C12')"""))
def any_country_column(spark, folder):
    return rounded(E.touching_countries(event_view(spark, folder), ["G1", "C7", "C12"]))


@check("b3_target_roots", with_("ev", """
    SELECT GlobalEventID, EventRootCode FROM ev WHERE EventRootCode IN ('14', '18', '19', '20')"""))
def target_roots(spark, folder):
    return E.with_target_roots(event_view(spark, folder)).select("GlobalEventID", "EventRootCode")


@check("b4_b5_optional_filters", with_("ev", """
    SELECT GlobalEventID, day, ActionGeo_CountryCode, QuadClass FROM ev
    WHERE ActionGeo_CountryCode IN ('G1', 'G4') AND QuadClass = '4'
      AND day BETWEEN 20240105 AND 20240122"""))
def optional_filters(spark, folder):
    kept = event_view(spark, folder).filter(
        E.country_condition("G1, G4") & E.quad_condition("4") & E.day_condition(20240105, 20240122))
    return kept.select("GlobalEventID", "day", "ActionGeo_CountryCode", "QuadClass")


@check("b6_actor_search", with_("ev", """
    SELECT GlobalEventID, Actor1Name, Actor2Name FROM ev
    WHERE Actor1Name ILIKE '%tor1%' OR Actor2Name ILIKE '%tor1%'"""))
def actor_search(spark, folder):
    return event_view(spark, folder).filter(E.actor_condition("tor1")).select(
        "GlobalEventID", "Actor1Name", "Actor2Name")


@check("b7_b15_defaults", with_("ev", """
    SELECT GlobalEventID, coalesce(nullif(Actor2CountryCode, ''), 'XX') AS c2,
           coalesce(nullif(Actor1Name, ''), 'unknown') AS a1,
           round(coalesce(CASE WHEN Actor1Name = '' THEN NULL ELSE GoldsteinScale END, 0.0), 9) AS g
    FROM ev"""))
def defaults(spark, folder):
    g = F.when(F.col("Actor1Name") != "", F.col("GoldsteinScale"))
    return rounded(event_view(spark, folder).select(
        "GlobalEventID", or_default(F.col("Actor2CountryCode"), "XX").alias("c2"),
        or_default(F.col("Actor1Name"), "unknown").alias("a1"), number_or(g).alias("g")))


@check("b8_pair_key", with_("keyed", "SELECT GlobalEventID, pair_key FROM keyed"))
def pair_key(spark, folder):
    return P.with_pair_key(event_view(spark, folder)).select("GlobalEventID", "pair_key")


@check("b9_b10_days_and_months", with_("ev", """
    SELECT day, strftime(strptime(CAST(day AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS event_date,
           epoch_ms(strptime(CAST(day AS VARCHAR), '%Y%m%d')) // 1000 AS utc_second,
           day // 100 AS month, strftime(event_date, '%Y-%m') AS month_label, count(*) AS n
    FROM ev GROUP BY ALL"""))
def days_and_months(spark, folder):
    day = F.col("day")
    return event_view(spark, folder).groupBy("day").agg(F.count("*").alias("n")).select(
        day, date_of_day(day).cast("string").alias("event_date"),
        (F.unix_date(date_of_day(day)).cast("long") * 86400).alias("utc_second"),
        month_of_day(day).alias("month"), month_label(month_of_day(day)).alias("month_label"), "n")


@check("b11_viewer_rows", with_("ev", """
    SELECT CAST(GlobalEventID AS VARCHAR) AS id, CAST(day AS VARCHAR) AS date,
           EventCode AS event_code, EventRootCode AS root, round(GoldsteinScale, 9) AS goldstein,
           Actor1Name AS actor1, Actor2Name AS actor2, SOURCEURL AS source_url FROM ev"""))
def viewer_rows(spark, folder):
    return rounded(E.viewer_rows(event_view(spark, folder)))


@check("b12_b13_annotation_units", with_("ev", """
    SELECT 'event-' || GlobalEventID AS unit_id, CAST(GlobalEventID AS VARCHAR) AS event_id,
           SOURCEURL AS source_url, EventCode AS event_code, EventRootCode AS root,
           CAST(day AS VARCHAR) AS day, round(GoldsteinScale, 9) AS goldstein,
           Actor1Name AS actor1, Actor1CountryCode AS actor1_country, Actor2Name AS actor2,
           Actor2CountryCode AS actor2_country
    FROM ev WHERE SOURCEURL IS NOT NULL AND SOURCEURL <> ''"""))
def annotation_units(spark, folder):
    return rounded(E.annotation_units(event_view(spark, folder)))


@check("b14_code_labels", with_("ev", """
    SELECT EventRootCode, QuadClass, ActionGeo_CountryCode,
           CASE EventRootCode WHEN '01' THEN 'Public Statement' WHEN '04' THEN 'Consult'
                WHEN '06' THEN 'Material Cooperation' WHEN '14' THEN 'Protest'
                WHEN '18' THEN 'Assault' END AS root_label,
           CASE QuadClass WHEN '1' THEN 'Verbal Cooperation' WHEN '2' THEN 'Material Cooperation'
                WHEN '3' THEN 'Verbal Conflict' ELSE 'Material Conflict' END AS quad_label,
           ActionGeo_CountryCode AS country_name, count(*) AS n
    FROM ev GROUP BY ALL"""))
def code_labels(spark, folder):
    codes = ["EventRootCode", "QuadClass", "ActionGeo_CountryCode"]
    groups = event_view(spark, folder).groupBy(*codes).agg(F.count("*").alias("n"))
    return E.decoded(groups).select(*codes, "root_label", "quad_label", "country_name", "n")


@check("e1_trailing_in_degree", with_("deg", """
    SELECT GlobalEventID, pair_key, day, causal_in_degree FROM deg"""))
def trailing_in_degree(spark, folder):
    return P.trailing_in_degree(event_view(spark, folder)).select(
        "GlobalEventID", "pair_key", "day", "causal_in_degree")


@check("e2_removal_counts", with_("deg", """
    SELECT count(*) AS total, count(*) FILTER (WHERE causal_in_degree <= 2) AS kept,
           count(*) FILTER (WHERE causal_in_degree > 2) AS removed FROM deg"""))
def removal_counts(spark, folder):
    return P.removal_counts(event_view(spark, folder))


@check("d9_in_degree_histogram", with_("deg", """
    SELECT CASE WHEN causal_in_degree >= 5 THEN '5+' ELSE CAST(causal_in_degree AS VARCHAR) END
             AS bucket, count(*) AS cnt,
           round(100.0 * count(*) / (SELECT count(*) FROM deg), 9) AS pct
    FROM deg GROUP BY 1"""))
def in_degree_histogram(spark, folder):
    return rounded(P.degree_histogram(event_view(spark, folder)))


@check("c3_precursor_links", with_("links", "SELECT later_id, earlier_id FROM links"))
def precursor_links(spark, folder):
    return P.precursor_links(P.low_in_degree(event_view(spark, folder)))


@check("k3_causal_filter", with_("served", """
    SELECT day, GlobalEventID, EventCode, EventRootCode, QuadClass,
           round(GoldsteinScale, 9) AS GoldsteinScale, Actor1Name, Actor1CountryCode, Actor2Name,
           Actor2CountryCode, ActionGeo_CountryCode, SOURCEURL, causal_in_degree, precursor_ids
    FROM served""").replace("FROM events)", "FROM events WHERE user_id % 10 < 5)"))
def causal_filter_job(spark, folder):
    """C2, D15, E2 in one job: events of half the places, whose in-degree counts these only."""
    return rounded(causal_filter(event_view(spark, folder), [f"G{i}" for i in range(5)]))


@check("k4_corpus_units", with_("ev", """
    SELECT 'event-' || GlobalEventID AS unit_id, SOURCEURL AS source_url, EventRootCode AS root
    FROM ev WHERE ActionGeo_CountryCode = 'G4' AND EventRootCode IN ('14', '18', '19', '20')
      AND (GlobalEventID * 7) % 20 <> 3"""))
def corpus_job(spark, folder):
    """Country, root-code and live-URL filters, then annotation units."""
    events = event_view(spark, folder)
    status = url_status(events).select("url", "alive")
    return corpus_units(events, "G4", status).select("unit_id", "source_url", "root")


@check("k4_corpus_queue", with_("ev", """
    , u AS (SELECT *, regexp_replace(SOURCEURL, '/a/([0-9]+)$', '/a/') || (GlobalEventID // 400) || '#' || (GlobalEventID % 3) AS raw FROM ev
            WHERE ActionGeo_CountryCode = 'G4' AND EventRootCode IN ('14', '18', '19', '20') AND (GlobalEventID * 7) % 20 <> 3)
    SELECT split_part(raw, '#', 1) AS url_key, count(*) AS units, min(raw) AS source_url,
           (SELECT count(DISTINCT raw) FROM u) AS source_url_rows, (SELECT count(DISTINCT split_part(raw, '#', 1)) FROM u) AS unique_url_keys
    FROM u GROUP BY split_part(raw, '#', 1)"""))
def corpus_queue(spark, folder):
    """The whole build: filters, live URLs, units, and the queue of their URL keys; events of one source share pages by parts of them."""
    events = event_view(spark, folder)
    n = F.col("GlobalEventID")
    shared = F.concat(F.regexp_replace("SOURCEURL", r"/a/[0-9]+$", "/a/"), F.floor(n / 400).cast("string"), F.lit("#"), (n % 3).cast("string"))
    live = url_status(events).filter("alive")
    pages = events.join(live.select(F.col("url").alias("SOURCEURL")), "SOURCEURL", "left_semi").withColumn("SOURCEURL", shared)
    status = pages.select(F.col("SOURCEURL").alias("url"), F.lit(True).alias("alive")).distinct()
    units, queue, summary = corpus_build(checkpointed(pages), "G4", status)
    counted = units.groupBy("url_key").agg(F.count("*").alias("units")).join(queue, "url_key")
    totals = checkpointed(summary)
    return counted.withColumns({c: totals.select(c).scalar() for c in ("source_url_rows", "unique_url_keys")})


def url_status(events):
    """A status per source URL: 404 for one residue of the event id, else 200."""
    code = F.when((F.col("GlobalEventID") * 7) % 20 == 3, 404).otherwise(200)
    return events.select(
        F.col("SOURCEURL").alias("url"), code.alias("status"), (code == 200).alias("alive"))


@check("c1_live_urls", with_("ev", """
    SELECT GlobalEventID, SOURCEURL FROM ev WHERE (GlobalEventID * 7) % 20 <> 3"""))
def live_urls(spark, folder):
    events = event_view(spark, folder)
    return E.only_live(events, url_status(events)).select("GlobalEventID", "SOURCEURL")
