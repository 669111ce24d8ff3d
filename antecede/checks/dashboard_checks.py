"""Dashboard aggregates."""

from __future__ import annotations

from antecede.checks import check
from antecede.checks.base import as_text, rounded, with_
from antecede.operators import dashboard as D, precedence as P
from antecede.sources.stand_ins import event_view

PLACES = ",".join(f"G{i}" for i in range(10))


@check("d1_overall_stats", with_("ev", """
    SELECT count(*) AS total_events, min(day) AS date_from, max(day) AS date_to,
           count(DISTINCT ActionGeo_CountryCode) AS countries FROM ev"""))
def overall(spark, folder):
    return D.overall(event_view(spark, folder))


@check("d2_country_nodes", with_("ev", """
    SELECT ActionGeo_CountryCode AS cc, count(*) AS n, round(avg(GoldsteinScale), 9) AS avg_g,
           count(*) FILTER (WHERE QuadClass IN ('3', '4')) AS n_conflict,
           round(count(*) FILTER (WHERE QuadClass IN ('3', '4')) / count(*), 9) AS conflict_ratio
    FROM ev GROUP BY 1"""))
def country_nodes(spark, folder):
    return rounded(D.country_nodes(event_view(spark, folder)))


@check("d3_e3_country_pairs", with_("ev", """
    , base AS (
        SELECT Actor1CountryCode AS c1, Actor2CountryCode AS c2, QuadClass AS q,
               EventRootCode AS rc, count(*) AS n, avg(GoldsteinScale) AS avg_g
        FROM ev WHERE Actor1CountryCode <> '' AND Actor2CountryCode <> '' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY n DESC, rc, q) AS rn FROM base)
    SELECT c1, c2, max(q) FILTER (WHERE rn = 1) AS dominant_q,
           max(rc) FILTER (WHERE rn = 1) AS dominant_rc, CAST(sum(n) AS BIGINT) AS total_n,
           round(avg(avg_g), 9) AS pair_avg_g, round(sum(avg_g * n) / sum(n), 9) AS weighted_avg_g
    FROM ranked GROUP BY c1, c2 HAVING sum(n) > 5"""))
def country_pairs(spark, folder):
    return rounded(D.country_pairs(event_view(spark, folder)))


@check("d4_edge_stats", with_("deg", """
    SELECT Actor1CountryCode, EventRootCode, count(*) AS total,
           round(avg(GoldsteinScale), 9) AS avg_goldstein, min(day) AS first_day,
           max(day) AS last_day,
           round(100.0 * count(*) FILTER (WHERE QuadClass IN ('3', '4')) / count(*), 9) AS conflict_pct,
           round(100.0 * count(*) FILTER (WHERE causal_in_degree > 0) / count(*), 9) AS causal_pct
    FROM deg GROUP BY 1, 2"""))
def edge_stats(spark, folder):
    return rounded(D.edge_stats(P.trailing_in_degree(event_view(spark, folder))))


@check("c5_usual_causes", with_("deg", """
    , months AS (SELECT DISTINCT ActionGeo_CountryCode AS cc, EventRootCode AS rc,
                        day // 100 AS month FROM deg),
    causes AS (SELECT ActionGeo_CountryCode AS cc, day // 100 AS month, EventRootCode AS cause_rc,
                      count(*) AS n FROM deg WHERE causal_in_degree = 0 GROUP BY ALL),
    sums AS (SELECT m.cc, m.rc, c.cause_rc, CAST(sum(c.n) AS BIGINT) AS n
             FROM months m JOIN causes c ON c.cc = m.cc AND c.month = m.month AND c.cause_rc <> m.rc
             GROUP BY ALL)
    SELECT cc, rc, cause_rc, n, place FROM (
        SELECT *, row_number() OVER (PARTITION BY cc, rc ORDER BY n DESC, cause_rc) AS place FROM sums)
    WHERE place <= 4"""))
def usual_causes(spark, folder):
    return D.usual_causes(P.trailing_in_degree(event_view(spark, folder)))


@check("d5_monthly_frequency", with_("ev", """
    SELECT EventRootCode, ActionGeo_CountryCode, strftime(event_date, '%Y-%m') AS month,
           count(*) AS n FROM ev GROUP BY ALL"""))
def monthly_frequency(spark, folder):
    return D.monthly_frequency(event_view(spark, folder))


@check("d6_timeline", with_("ev", """
    SELECT strftime(event_date, '%Y-%m') AS month, count(*) FILTER (WHERE QuadClass = '1') AS q1,
           count(*) FILTER (WHERE QuadClass = '2') AS q2, count(*) FILTER (WHERE QuadClass = '3') AS q3,
           count(*) FILTER (WHERE QuadClass = '4') AS q4,
           round(avg(GoldsteinScale), 9) AS goldstein_trend
    FROM ev GROUP BY 1"""))
def timeline(spark, folder):
    return rounded(D.timeline(event_view(spark, folder), PLACES))


@check("d7_country_profiles", with_("ev", """
    , m AS (SELECT ActionGeo_CountryCode AS code, day // 100 AS month, count(*) AS n,
                   sum(GoldsteinScale) AS g, count(*) FILTER (WHERE QuadClass = '1') AS q1,
                   count(*) FILTER (WHERE QuadClass = '2') AS q2,
                   count(*) FILTER (WHERE QuadClass = '3') AS q3,
                   count(*) FILTER (WHERE QuadClass = '4') AS q4
            FROM ev GROUP BY ALL)
    SELECT code, CAST(sum(n) AS BIGINT) AS total_events, round(sum(g) / sum(n), 9) AS avg_goldstein,
           CAST(sum(q1) AS BIGINT) AS q1, CAST(sum(q2) AS BIGINT) AS q2, CAST(sum(q3) AS BIGINT) AS q3,
           CAST(sum(q4) AS BIGINT) AS q4, string_agg(n, ',' ORDER BY month) AS monthly_trend,
           round((sum(q3) + sum(q4)) / sum(n), 9) AS conflict_ratio
    FROM m GROUP BY code"""))
def country_profiles(spark, folder):
    profiles = D.country_profiles(event_view(spark, folder), PLACES)
    return rounded(profiles.withColumn("monthly_trend", as_text("monthly_trend")))


@check("d8_interaction_matrix", with_("ev", """
    SELECT Actor1CountryCode AS c1, Actor2CountryCode AS c2, count(*) AS n,
           round(avg(GoldsteinScale), 9) AS avg_g
    FROM ev WHERE Actor1CountryCode <> '' AND Actor2CountryCode <> '' GROUP BY 1, 2"""))
def interaction_matrix(spark, folder):
    return rounded(D.interaction_matrix(event_view(spark, folder)))


@check("f1_sample_events", with_("deg", """
    SELECT GlobalEventID, day, round(GoldsteinScale, 9) AS GoldsteinScale, causal_in_degree
    FROM deg WHERE EventRootCode = '14' AND ((Actor1CountryCode = 'C4' AND Actor2CountryCode = 'C9')
        OR ActionGeo_CountryCode = 'G4')
    ORDER BY abs(deg.GoldsteinScale) DESC, day DESC, GlobalEventID DESC LIMIT 8"""))
def sample_events(spark, folder):
    rows = D.sample_events(P.trailing_in_degree(event_view(spark, folder)), "14", "C4", "C9", "G4")
    return rounded(rows.select("GlobalEventID", "day", "GoldsteinScale", "causal_in_degree"))


@check("f2_explainable_seeds", with_("served", """
    SELECT GlobalEventID, day, EventRootCode, precursor_ids FROM served
    WHERE ActionGeo_CountryCode = 'G4' AND EventRootCode <> '' AND precursor_ids <> ''
      AND day > 20240108
    ORDER BY abs(GoldsteinScale) DESC, day DESC, GlobalEventID DESC LIMIT 12"""))
def explainable_seeds(spark, folder):
    served = P.low_in_degree(event_view(spark, folder))
    return D.explainable_seeds(served, "G4", 20240108).select(
        "GlobalEventID", "day", "EventRootCode", "precursor_ids")


@check("f3_event_page", with_("ev", """
    SELECT GlobalEventID, day, Actor1Name,
           (SELECT count(*) FROM ev WHERE ActionGeo_CountryCode IN ('G2', 'G5')
              AND (Actor1Name ILIKE '%actor2%' OR Actor2Name ILIKE '%actor2%')) AS total
    FROM ev WHERE ActionGeo_CountryCode IN ('G2', 'G5')
      AND (Actor1Name ILIKE '%actor2%' OR Actor2Name ILIKE '%actor2%')
    ORDER BY day DESC, GlobalEventID DESC LIMIT 50 OFFSET 100"""))
def event_page(spark, folder):
    rows, total = D.event_page(event_view(spark, folder), "actor2", "G2,G5", page=3)
    return rows.select("GlobalEventID", "day", "Actor1Name").withColumn("total", total.scalar())


@check("e4_daily_seeds", with_("served", """
    SELECT ActionGeo_CountryCode, EventRootCode, day, GlobalEventID, Actor1Name, Actor2Name,
           round(GoldsteinScale, 9) AS GoldsteinScale, SOURCEURL FROM (
        SELECT *, row_number() OVER (PARTITION BY ActionGeo_CountryCode, EventRootCode, day
                   ORDER BY abs(GoldsteinScale) DESC, GlobalEventID) AS rn
        FROM served WHERE precursor_ids <> '') WHERE rn = 1"""))
def daily_seeds(spark, folder):
    return rounded(D.daily_seeds(P.low_in_degree(event_view(spark, folder))))
