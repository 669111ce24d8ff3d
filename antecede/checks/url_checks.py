"""URL keys, status summaries, samples and incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import define, with_
from antecede.functions import urls as U
from antecede.operators import urlset as Q
from antecede.sources.stand_ins import event_view, page_view, status_log, table
from antecede.streaming import incremental as I

define("urlkeys", r"""
    SELECT page_id, url, lower(regexp_extract(url, '^(https?)://', 1, 'i')) || '://'
           || lower(regexp_extract(url, '^https?://([^/?#:]*)', 1, 'i'))
           || CASE WHEN regexp_extract(url, '^https?://[^/?#]*?(:[0-9]+)', 1, 'i') IN (':80', ':443')
                   THEN '' ELSE regexp_extract(url, '^https?://[^/?#:]*(:[0-9]+)', 1, 'i') END
           || CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1, 'i') = '' THEN '/'
                   ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1, 'i') END
           || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS url_key,
           lower(regexp_extract(url, '^https?://([^/?#:]*)', 1, 'i')) AS host
    FROM pages""")
define("log", """
    SELECT page_id, url, url_key, host,
           CASE page_id % 13 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 503
                WHEN 4 THEN 410 WHEN 5 THEN NULL WHEN 6 THEN 301 WHEN 7 THEN 418 ELSE 200 END AS status
    FROM urlkeys""", "urlkeys")
define("pageviews", """
    SELECT CAST(l.page_id AS BIGINT) AS document_id, url_key, host,
           CASE WHEN status IN (404, 410, 451) THEN 'dead' WHEN status IN (401, 403) THEN 'blocked'
                WHEN status IS NULL OR status IN (408, 425, 429) OR status >= 500
                    THEN 'retryable_error'
                WHEN status < 200 OR status >= 400 THEN 'http_error'
                ELSE 'extracted' END AS status, length(html) AS text_length,
           html ILIKE '%</html>%' AS complete_html, html ILIKE '%noarchive%' AS paywalled
    FROM log l JOIN pages p USING (page_id)""", "log")


@check("h1_normalized_urls", with_("urlkeys", "SELECT page_id, url_key FROM urlkeys"))
def normalized_urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url_key"))


@check("h2_h3_hosts_and_slugs", with_("urlkeys", """
    SELECT page_id, host, regexp_replace(host, '^www\\.', '') AS outlet,
           regexp_replace(regexp_replace(url, '^[^/]*/[^/]*/[^/]*/', ''), '[-_/]', ' ', 'g') AS slug
    FROM urlkeys"""))
def hosts_and_slugs(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", U.hostname(url).alias("host"), U.outlet(url).alias("outlet"),
        U.slug_words(url).alias("slug"))


@check("g6_url_queue", with_("urlkeys", """
    SELECT url_key, min(url) AS source_url FROM urlkeys GROUP BY url_key"""))
def url_queue(spark, folder):
    return Q.url_queue(table(spark, folder, "pages").withColumnRenamed("url", "SOURCEURL"))


@check("d18_queue_summary", with_("urlkeys", """
    SELECT count(DISTINCT url) AS source_url_rows, count(DISTINCT url_key) AS unique_url_keys,
           CAST(0 AS BIGINT) AS invalid_urls,
           count(DISTINCT url) - count(DISTINCT url_key) AS normalization_collisions FROM urlkeys"""))
def queue_summary(spark, folder):
    return Q.queue_summary(table(spark, folder, "pages").withColumnRenamed("url", "SOURCEURL"))


@check("d16_first_event_day", with_("ev", """
    SELECT SOURCEURL AS url_key, strftime(min(event_date), '%Y-%m-%d') AS event_day
    FROM ev GROUP BY 1"""))
def first_event_day(spark, folder):
    return Q.first_event_day(event_view(spark, folder)).withColumn(
        "event_day", F.col("event_day").cast("string"))


@check("h29_fetch_outcomes", with_("log", """
    SELECT page_id, status IS NOT NULL AND status NOT IN (404, 410, 451) AS alive,
           CASE WHEN status IN (404, 410, 451) THEN 'dead' WHEN status IN (401, 403) THEN 'blocked'
                WHEN status IS NULL OR status IN (408, 425, 429) OR status >= 500
                    THEN 'retryable_error'
                WHEN status < 200 OR status >= 400 THEN 'http_error' ELSE 'fetched' END AS outcome
    FROM log"""))
def fetch_outcomes(spark, folder):
    status = F.col("status")
    return status_log(spark, folder).select(
        "page_id", U.is_alive(status).alias("alive"), U.outcome_class(status).alias("outcome"))


@check("d17_status_summary", with_("log", """
    SELECT coalesce(CAST(status AS VARCHAR), 'timeout') AS outcome, count(DISTINCT url) AS urls,
           count(DISTINCT url) FILTER (WHERE status NOT IN (404, 410, 451)) AS live_urls,
           count(*) AS input_rows, count(*) FILTER (WHERE status NOT IN (404, 410, 451)) AS output_rows
    FROM log GROUP BY 1"""))
def status_summary(spark, folder):
    log = status_log(spark, folder)
    cache = Q.checked(log).select("page_id", "alive", "status", F.lit("timeout").alias("reason"))
    return Q.status_summary(log.select("page_id", F.col("url").alias("SOURCEURL")), cache, "page_id")


@check("d19_fetch_summary", with_("pageviews", """
    , top AS (SELECT host FROM pageviews GROUP BY host ORDER BY count(*) DESC, host LIMIT 10),
    r AS (SELECT *, host IN (SELECT host FROM top) AS is_top, status = 'extracted' AS good FROM pageviews)
    SELECT count(*) AS sample_size,
           round(round(count(*) FILTER (WHERE good) / count(*), 9), 4) AS success_rate,
           round(round(count(*) FILTER (WHERE good AND is_top) / count(*) FILTER (WHERE is_top), 9), 4)
               AS top_hosts_rate,
           round(round(count(*) FILTER (WHERE good AND NOT is_top)
                       / count(*) FILTER (WHERE NOT is_top), 9), 4) AS long_tail_rate,
           round(round(count(*) FILTER (WHERE paywalled) / count(*), 9), 4) AS paywall_share,
           round(round(count(*) FILTER (WHERE complete_html) / count(*), 9), 4) AS complete_html_share,
           count(*) FILTER (WHERE good) AS extracted,
           CAST(list_sort(list(text_length) FILTER (WHERE good))
                [1 + count(*) FILTER (WHERE good) // 2] AS INTEGER) AS median_text_length
    FROM r"""))
def fetch_summary(spark, folder):
    records = page_view(spark, folder)
    hosts = records.groupBy("host").agg(F.count("*").alias("urls"))
    return Q.fetch_summary(records, hosts)


@check("e10_host_round_robin", with_("pageviews", """
    SELECT url_key, host, turn FROM (
        SELECT url_key, host, row_number() OVER (PARTITION BY host ORDER BY url_key) AS turn
        FROM (SELECT DISTINCT url_key, host FROM pageviews))
    ORDER BY turn, host LIMIT 80"""))
def host_round_robin(spark, folder):
    urls = page_view(spark, folder).select("url_key").distinct()
    return Q.by_host_round_robin(urls, 80).select("url_key", "host", "turn")


@check("e11_status_sample", with_("pageviews", """
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5(url_key), document_id) AS rn
                 FROM pageviews)
    SELECT document_id, url_key, status, CAST(stage AS BIGINT) AS stage FROM (
        SELECT *, CASE WHEN rn <= 20 AND status = 'extracted' THEN 1
                       WHEN rn <= 20 AND status = 'dead' THEN 2
                       WHEN rn <= 20 AND status = 'blocked' THEN 3 ELSE 4 END AS stage FROM ranked)
    ORDER BY stage, md5(url_key), document_id LIMIT 60"""))
def status_sample(spark, folder):
    rows = Q.status_sample(page_view(spark, folder), ["extracted", "dead", "blocked"], 60)
    return rows.select("document_id", "url_key", "status", F.col("stage").cast("bigint"))


@check("f6_seeded_sample", with_("pageviews", """
    , first AS (SELECT url_key FROM (SELECT DISTINCT url_key FROM pageviews)
                ORDER BY md5('screen' || url_key), url_key LIMIT 40)
    SELECT url_key FROM (SELECT DISTINCT url_key FROM pageviews)
    WHERE url_key NOT IN (SELECT url_key FROM first)
    ORDER BY md5('screen' || url_key), url_key LIMIT 60"""))
def seeded_sample(spark, folder):
    urls = page_view(spark, folder).select("url_key").distinct()
    first = Q.seeded_sample(urls, "url_key", "screen", 40)
    return Q.seeded_sample(urls, "url_key", "screen", 60, taken=first)


@check("c20_group_sources", with_("links ev", """
    , placed AS (SELECT ev.*, GlobalEventID IN (SELECT earlier_id FROM links) AS is_cause FROM ev),
    urls AS (SELECT *, row_number() OVER (PARTITION BY day, EventRootCode, ActionGeo_CountryCode
                                          ORDER BY SOURCEURL) AS turn
             FROM (SELECT DISTINCT day, EventRootCode, ActionGeo_CountryCode, SOURCEURL FROM ev))
    SELECT GlobalEventID, u.SOURCEURL, u.turn,
           regexp_extract(u.SOURCEURL, '://([^/]+)', 1) AS domain
    FROM placed p JOIN urls u USING (day, EventRootCode, ActionGeo_CountryCode)
    WHERE is_cause AND u.turn <= 12
    UNION ALL
    SELECT GlobalEventID, SOURCEURL, 1, regexp_extract(SOURCEURL, '://([^/]+)', 1)
    FROM placed WHERE NOT is_cause"""))
def group_sources(spark, folder):
    """Includes the EXISTS flag of C12."""
    from antecede.operators import precedence as P
    from antecede.operators.review import with_flag

    events = event_view(spark, folder)
    causes = P.precursor_links(P.low_in_degree(events)).select(
        F.col("earlier_id").alias("GlobalEventID"))
    stored = with_flag(events.select("GlobalEventID"), causes, "GlobalEventID", "is_cause")
    return Q.group_sources(events, stored)


@check("c9_insert_if_absent", with_("urlkeys", """
    SELECT url_key, min(page_id) AS page_id FROM urlkeys
    WHERE url_key NOT IN (SELECT DISTINCT url_key FROM urlkeys WHERE url NOT LIKE '%?%')
    GROUP BY url_key"""))
def insert_if_absent(spark, folder):
    keyed = table(spark, folder, "pages").select("page_id", "url", U.normalize_url(F.col("url")).alias("url_key"))
    rows = keyed.groupBy("url_key").agg(F.min("page_id").alias("page_id"))
    plain = keyed.filter(~F.contains(F.col("url"), F.lit("?"))).select("url_key").distinct()
    return I.new_rows(plain, rows, ["url_key"])


@check("c10_supersede_on_change", """
    SELECT doc_id, sha256(text) AS content, source, lang,
           doc_id IN (SELECT doc_id FROM labels) AS supersedes
    FROM documents d
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)""")
def supersede_on_change(spark, folder):
    """The stored table holds the labelled documents, some with another content hash."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.sha2("text", 256).alias("content"), "source", "lang")
    labels = table(spark, folder, "labels")
    changed = F.when(F.col("quality") == 0, F.lit("changed")).otherwise(F.col("content"))
    stored = docs.join(labels, "doc_id").select("doc_id", changed.alias("content"), "source", "lang")
    return I.changed_rows(stored, docs, "doc_id", ["content", "source", "lang"])


@check("e6_latest_per_key", """
    SELECT conv_id, turn, role, md5(text) AS text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    WHERE rn = 1""")
def latest_per_key(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("text", F.md5("text"))
    return I.latest_per_key(rows, ["conv_id"], ["turn"])
