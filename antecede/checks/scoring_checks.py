"""Type-pair matrix, tokens, channel scores, cause scoring and negative controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import define, rounded, with_
from antecede.functions import scores as S
from antecede.operators import actors as A, precedence as P, typepairs as T
from antecede.plans import controls as K2, score_causes as K1
from antecede.session import checkpointed
from antecede.sources.stand_ins import event_view

define("daily", """
    SELECT ActionGeo_CountryCode AS cc, EventRootCode AS rc, event_date AS d, count(*) AS n
    FROM served GROUP BY ALL""", "served")
define("spikes", """
    SELECT daily.* FROM daily JOIN (SELECT cc, rc, quantile_cont(n, 0.75) AS t FROM daily
                                    GROUP BY cc, rc) USING (cc, rc) WHERE n > t""", "daily")
define("joined", """
    SELECT c.cc, c.rc AS crc, e.rc AS erc, c.d AS cd, e.d AS ed
    FROM spikes c JOIN spikes e ON e.cc = c.cc AND e.d > c.d AND e.d <= c.d + INTERVAL 7 DAY""",
       "spikes")
define("matrix", """
    SELECT cc, crc, erc, cause_hits, effect_hits, cause_days, effect_days, total_days,
           round(round(cause_hits / cause_days, 9), 4) AS sufficiency,
           round(round(effect_hits / effect_days, 9), 4) AS necessity,
           round(round((cause_hits / cause_days) / (effect_days / total_days), 9), 4) AS lift
    FROM (SELECT cc, crc, erc, count(DISTINCT cd) AS cause_hits, count(DISTINCT ed) AS effect_hits
          FROM joined GROUP BY ALL)
    JOIN (SELECT cc, rc AS crc, count(DISTINCT d) AS cause_days FROM spikes GROUP BY ALL) USING (cc, crc)
    JOIN (SELECT cc, rc AS erc, count(DISTINCT d) AS effect_days FROM spikes GROUP BY ALL) USING (cc, erc)
    JOIN (SELECT cc, count(DISTINCT d) AS total_days FROM spikes GROUP BY ALL) USING (cc)""",
       "joined", "spikes")
define("tok", """
    SELECT DISTINCT regexp_replace(w, '[^A-Z0-9]', '', 'g') AS t FROM (
        SELECT unnest(string_split(replace(upper(n), ',', ' '), ' ')) AS w
        FROM (SELECT DISTINCT unnest([Actor1Name, Actor2Name]) AS n FROM served))
    WHERE length(regexp_replace(w, '[^A-Z0-9]', '', 'g')) > 2""", "served")
define("idf", """
    SELECT t, df, df / total AS share, ln(total / (1 + df)) AS idf
    FROM (SELECT t, (SELECT count(*) FROM served
                     WHERE Actor1Name ILIKE '%' || t || '%' OR Actor2Name ILIKE '%' || t || '%') AS df
          FROM tok), (SELECT count(*) AS total FROM served)""", "tok", "served")
define("tgt", """
    SELECT *, GlobalEventID AS id FROM served WHERE precursor_ids <> '' AND EventRootCode <> ''""",
       "served")
define("probe", """
    SELECT id, t, idf, idf / (CASE WHEN sum(idf) OVER (PARTITION BY id) = 0 THEN 1.0
                                   ELSE sum(idf) OVER (PARTITION BY id) END) AS w
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idf DESC, t) AS rn
          FROM (SELECT DISTINCT id, unnest([upper(Actor1Name), upper(Actor2Name)]) AS t FROM tgt)
          JOIN idf USING (t) WHERE df > 0 AND share <= 0.05)
    WHERE rn <= 3""", "tgt", "idf")
define("grp", """
    SELECT ActionGeo_CountryCode AS cc, event_date AS c_date, EventRootCode AS c_rc,
           count(*) AS event_count,
           count(DISTINCT regexp_extract(SOURCEURL, '://([^/]+)', 1)) AS domains,
           avg(GoldsteinScale) AS avg_goldstein, min(GlobalEventID) AS rep_id
    FROM served GROUP BY ALL""", "served")
define("hits", """
    SELECT ActionGeo_CountryCode AS cc, event_date AS c_date, EventRootCode AS c_rc, t,
           count(*) AS h
    FROM served JOIN (SELECT t FROM idf WHERE df > 0 AND share <= 0.05)
      ON Actor1Name ILIKE '%' || t || '%' OR Actor2Name ILIKE '%' || t || '%'
    GROUP BY ALL""", "served", "idf")
define("doc", """
    SELECT DISTINCT l.later_id AS id, s.event_date AS c_date, s.EventRootCode AS c_rc
    FROM links l JOIN served s ON s.GlobalEventID = l.earlier_id""", "links", "served")
define("wins", """
    WITH moved AS (
        SELECT *, least(greatest(event_date + CAST((CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END)
                          * (8 + (x // 2) % 13) AS INTEGER), DATE '2024-01-08'),
                        DATE '2024-01-29') AS m
        FROM (SELECT *, CAST('0x' || substr(sha256('controls' || id), 1, 8) AS BIGINT) AS x FROM tgt))
    SELECT id, 'real' AS arm, event_date - 7 AS a, event_date - 1 AS z FROM tgt
    UNION ALL SELECT id, 'shuffled', m - 7, m - 1 FROM moved
    UNION ALL SELECT id, 'future', event_date + 1, event_date + 7 FROM tgt""", "tgt")
define("scored", """
    WITH cand AS (
        SELECT t.id, w.arm, t.ActionGeo_CountryCode AS cc, t.event_date AS t_date,
               t.EventRootCode AS target_root, g.c_date, g.c_rc, g.event_count, g.domains,
               g.avg_goldstein, g.rep_id
        FROM wins w JOIN tgt t USING (id)
        JOIN grp g ON g.cc = t.ActionGeo_CountryCode AND g.c_date BETWEEN w.a AND w.z
        WHERE g.event_count >= 3),
    act AS (SELECT c.id, c.arm, c.c_date, c.c_rc, sum(p.w * h.h) AS hit
            FROM cand c JOIN probe p USING (id)
            JOIN hits h ON h.cc = c.cc AND h.c_date = c.c_date AND h.c_rc = c.c_rc AND h.t = p.t
            GROUP BY ALL),
    raw AS (
        SELECT c.*, m.sufficiency, m.necessity, m.lift,
               CASE WHEN d.id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS documented,
               least(ln(1 + domains) / ln(41), 1.0) AS corroboration,
               least(greatest((coalesce(lift, 0) - 1) / 7.0, 0), 1) AS prior,
               least(0.75 * coalesce(sufficiency, 0) + 0.25 * coalesce(necessity, 0), 1.0) AS contrastive,
               least(coalesce(hit, 0) / event_count, 1.0) AS actors
        FROM cand c LEFT JOIN act USING (id, arm, c_date, c_rc)
        LEFT JOIN matrix m ON m.cc = c.cc AND m.crc = c.c_rc AND m.erc = c.target_root
        LEFT JOIN doc d ON d.id = c.id AND d.c_date = c.c_date AND d.c_rc = c.c_rc AND c.arm = 'real'),
    shown AS (
        SELECT *, round(round(documented, 9), 3) AS s_doc, round(round(corroboration, 9), 3) AS s_cor,
               round(round(prior, 9), 3) AS s_pri, round(round(contrastive, 9), 3) AS s_con,
               round(round(actors, 9), 3) AS s_act FROM raw),
    fusedz AS (SELECT *, -3.2::DOUBLE + 2.6::DOUBLE * s_doc + 1.4::DOUBLE * s_cor + 1.1::DOUBLE * s_pri
                      + 1.3::DOUBLE * s_con + 0.9::DOUBLE * s_act AS zz FROM shown)
    SELECT *, 1 / (1 + exp(-zz)) AS conf, round(round(1 / (1 + exp(-zz)), 9), 4) AS confidence,
           CASE WHEN documented >= 0.5 AND corroboration >= 0.5 THEN 'confirmed'
                WHEN documented >= 0.5 THEN 'reported'
                WHEN (prior + contrastive + actors) / 3 >= 0.45 AND coalesce(sufficiency, 0) >= 0.30
                    THEN 'pattern'
                WHEN 1 / (1 + exp(-zz)) >= 0.08 THEN 'weak' ELSE 'dropped' END AS grade
    FROM fusedz""", "tgt", "wins", "grp", "probe", "hits", "matrix", "doc")
define("best", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, arm, c_rc
                       ORDER BY confidence DESC, greatest(t_date - c_date, 0), c_date) AS rn FROM scored)
    WHERE rn = 1""", "scored")


def served(spark, folder):
    return P.low_in_degree(event_view(spark, folder))


def stored(spark, folder):
    """The served table written once, for jobs that read it several times."""
    return checkpointed(served(spark, folder))


def targets_of(events):
    return events.filter("precursor_ids <> '' AND EventRootCode <> ''")


def best_of(spark, folder):
    events = stored(spark, folder)
    return K1.score_targets(events, targets_of(events))


@check("d11_spike_days", with_("spikes", """
    SELECT cc, rc, strftime(d, '%Y-%m-%d') AS d, n FROM spikes"""))
def spike_days(spark, folder):
    return T.spike_days(served(spark, folder)).select("cc", "rc", F.col("d").cast("string"), "n")


@check("c4_spike_interval_join", with_("joined", """
    SELECT cc, crc, erc, CAST(ed - cd AS BIGINT) AS gap, count(*) AS pairs FROM joined GROUP BY ALL"""))
def spike_interval_join(spark, folder):
    pairs = T.spike_pairs(T.spike_days(served(spark, folder)))
    return pairs.groupBy("cc", "crc", "erc", F.datediff("ed", "cd").cast("bigint").alias("gap")).agg(
        F.count("*").alias("pairs"))


@check("d12_type_pair_matrix", with_("matrix", "SELECT * FROM matrix"))
def type_pair_matrix(spark, folder):
    """Includes C6 and C7."""
    return T.type_pair_matrix(served(spark, folder))


@check("f4_strongest_pairs", with_("matrix", """
    SELECT cc, crc, erc, lift, row_number() OVER (PARTITION BY cc ORDER BY lift DESC, crc, erc) AS place
    FROM matrix WHERE crc <> erc QUALIFY place <= 40"""))
def strongest_pairs(spark, folder):
    return T.strongest_pairs(T.type_pair_matrix(served(spark, folder))).select(
        "cc", "crc", "erc", "lift", "place")


@check("d10_candidate_groups", with_("grp", """
    SELECT cc, strftime(c_date, '%Y-%m-%d') AS c_date, c_rc, event_count, domains,
           round(avg_goldstein, 9) AS avg_goldstein, rep_id FROM grp"""))
def candidate_groups(spark, folder):
    return rounded(K1.candidate_groups(served(spark, folder)).withColumn(
        "c_date", F.col("c_date").cast("string")))


@check("d13_token_idf", with_("idf", """
    SELECT t AS token, df, round(share, 9) AS share, round(idf, 9) AS idf FROM idf"""))
def token_idf(spark, folder):
    return rounded(K1.token_tables(stored(spark, folder))[0])


@check("f5_rarest_probes", with_("probe tgt", """
    SELECT DISTINCT Actor1Name, Actor2Name, t AS token, round(w, 9) AS weight
    FROM probe JOIN tgt USING (id)"""))
def rarest_probes(spark, folder):
    events = stored(spark, folder)
    stats = K1.token_tables(events)[0]
    probes = A.pair_probes(A.actor_pairs(targets_of(events)), stats)
    return rounded(probes.select("Actor1Name", "Actor2Name", F.inline("probes")))


@check("d14_token_hits", with_("hits", """
    SELECT cc, strftime(c_date, '%Y-%m-%d') AS c_date, c_rc, t AS token, h AS hits FROM hits"""))
def token_hits(spark, folder):
    events = stored(spark, folder)
    stats, matches, _, pairs = K1.token_tables(events)
    return K1.group_hits(events, matches, A.usable(stats).select("token"), pairs).withColumn("c_date", F.col("c_date").cast("string"))


@check("c8_documented_groups", with_("doc", """
    SELECT id AS target_id, strftime(c_date, '%Y-%m-%d') AS c_date, c_rc FROM doc"""))
def documented_groups(spark, folder):
    events = served(spark, folder)
    return K1.documented_groups(targets_of(events), events).withColumn(
        "c_date", F.col("c_date").cast("string"))


@check("k1_score_causes", with_("best", """
    SELECT id AS target_id, c_rc AS root_code, CAST(strftime(c_date, '%Y%m%d') AS INTEGER) AS cause_day,
           event_count, domains, rep_id, s_doc AS documented, s_cor AS corroboration, s_pri AS prior,
           s_con AS contrastive, s_act AS actors, confidence, grade
    FROM best WHERE arm = 'real'"""))
def score_causes(spark, folder):
    """H14, H15, H16, E5 for every event with recorded precursors."""
    return best_of(spark, folder).select(
        "target_id", "root_code", "cause_day", "event_count", "domains", "rep_id", "documented",
        "corroboration", "prior", "contrastive", "actors", "confidence", "grade")


@check("d32_grade_coverage", with_("best", """
    SELECT id AS target_id, count(*) AS candidates,
           count(*) FILTER (WHERE grade = 'confirmed') AS confirmed,
           count(*) FILTER (WHERE grade = 'reported') AS reported,
           count(*) FILTER (WHERE grade = 'pattern') AS pattern,
           count(*) FILTER (WHERE grade = 'weak') AS weak,
           count(*) FILTER (WHERE grade = 'dropped') AS dropped,
           round(round(sum(CASE WHEN grade IN ('confirmed', 'reported', 'pattern') THEN confidence
                                ELSE 0 END) / sum(confidence), 9), 3) AS coverage
    FROM best WHERE arm = 'real' GROUP BY id"""))
def grade_coverage(spark, folder):
    return K1.target_summary(best_of(spark, folder))


@check("h15_h16_terms_and_words", with_("best", """
    SELECT id AS target_id, c_rc AS root_code, round(round(2.6::DOUBLE * s_doc, 9), 3) AS documented_term,
           round(round(1.3::DOUBLE * s_con, 9), 3) AS contrastive_term,
           CASE WHEN s_cor >= 0.7 THEN 'strong' WHEN s_cor >= 0.4 THEN 'moderate'
                WHEN s_cor >= 0.15 THEN 'weak' WHEN s_cor > 0 THEN 'very weak' ELSE 'none' END AS outlets
    FROM best WHERE arm = 'real'"""))
def terms_and_words(spark, folder):
    best = best_of(spark, folder)
    names = ("documented", "corroboration", "prior", "contrastive", "actors")
    terms = S.terms({n: F.col(n) for n in names})
    return best.select(
        "target_id", "root_code", terms[0]["contribution"].alias("documented_term"),
        terms[3]["contribution"].alias("contrastive_term"),
        S.strength_word(F.col("corroboration")).alias("outlets"))


@check("h17_h18_trace_and_reasons")
def trace_and_reasons(spark, folder):
    return K1.listed_candidates(best_of(spark, folder)).select(
        "target_id", "root_code", "rank", S.top_reasons(S.trace()).alias("top_reasons"))


def arms_of(spark, folder):
    events = stored(spark, folder)
    targets = targets_of(events)
    windows = K2.control_windows(targets, "2024-01-08", "2024-01-29", near=8, far=20)
    return K2.scored_arms(events, targets, windows)


@check("k2_d22_control_arms", with_("best", """
    SELECT arm, count(*) AS pairs,
           round(round(count(*) FILTER (WHERE grade = 'confirmed') / count(*), 9), 4) AS confirmed,
           round(round(count(*) FILTER (WHERE grade = 'reported') / count(*), 9), 4) AS reported,
           round(round(count(*) FILTER (WHERE grade = 'pattern') / count(*), 9), 4) AS pattern,
           round(round(count(*) FILTER (WHERE grade = 'weak') / count(*), 9), 4) AS weak,
           round(round(count(*) FILTER (WHERE grade = 'dropped') / count(*), 9), 4) AS dropped,
           round(round(count(*) FILTER (WHERE grade IN ('confirmed', 'reported', 'pattern'))
                       / count(*), 9), 4) AS kept_rate,
           round(round(avg(confidence), 9), 4) AS mean_confidence
    FROM best GROUP BY arm"""))
def control_arms(spark, folder):
    return K2.arm_summary(arms_of(spark, folder))


@check("d22_discrimination", with_("best", """
    , share AS (SELECT arm, grade, round(round(count(*) / sum(count(*)) OVER (PARTITION BY arm), 9), 4) AS share FROM best GROUP BY arm, grade),
    names AS (SELECT unnest(['confirmed', 'reported', 'pattern', 'weak', 'dropped']) AS grade)
    SELECT n.grade, CASE WHEN coalesce(s.share, 0) > 0 THEN round(round(coalesce(r.share, 0) / s.share, 9), 2) END AS discrimination
    FROM names n LEFT JOIN share r ON r.grade = n.grade AND r.arm = 'real'
    LEFT JOIN share s ON s.grade = n.grade AND s.arm = 'shuffled'"""))
def grade_discrimination(spark, folder):
    """How much oftener each grade falls on real windows than on shuffled ones."""
    return K2.discrimination(checkpointed(K2.arm_summary(arms_of(spark, folder))))
