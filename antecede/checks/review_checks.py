"""Claims, dealing, progress, agreement and branching."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import define, rounded, with_
from antecede.functions.codes import EVIDENCE_QUALITIES, REJECT_REASONS, RELATIONS
from antecede.operators import review as R
from antecede.session import checkpointed
from antecede.sources.stand_ins import claim_view, event_view, judgement_view, table

PEOPLE = ["ana", "ben", "chi", "dov"]
LIST = lambda names: "['" + "', '".join(names) + "']"


def pick(names, n):
    return f"{LIST(names)}[1 + ({n}) % {len(names)}]"


define("claims", """
    SELECT 'cl:' || substr(sha256(effect_id || '<-' || cause_id), 1, 16) AS claim_id, p.*,
           c.EventRootCode AS cause_type, c.event_date AS cause_date,
           CAST(effect_date - c.event_date AS INTEGER) AS lag_days,
           CASE WHEN (effect_id * 31 + cause_id * 17) % 97 > 0
                THEN ((effect_id * 31 + cause_id * 17) % 97) / 96.0::DOUBLE END AS machine_strength
    FROM (SELECT effect_id, effect_type, effect_date, cause_id, min(lvl) AS expansion_level FROM (
            SELECT GlobalEventID AS effect_id, EventRootCode AS effect_type, event_date AS effect_date,
                   unnest([GlobalEventID * 9 // 10, GlobalEventID * 7 // 10, GlobalEventID * 4 // 10])
                     AS cause_id, unnest([1, 2, 3]) AS lvl FROM ev)
          WHERE cause_id < effect_id GROUP BY ALL) p
    JOIN ev c ON c.GlobalEventID = p.cause_id""", "ev")


def judged_sql(second: bool) -> str:
    flip = "(cause_id % 10 = 0)" if second else "false"
    shift = "(CASE WHEN cause_id % 6 = 0 THEN 1 ELSE 0 END)" if second else "0"
    return f"""
    SELECT claim_id, effect_id, cause_id, expansion_level, lag_days,
           CASE WHEN ok THEN 'accept' ELSE 'reject' END AS decision,
           CASE WHEN ok THEN {pick(RELATIONS, f'effect_id + cause_id + {shift}')} END AS relation,
           CASE WHEN ok THEN 1 + (effect_id + cause_id) % 3 END AS strength,
           CASE WHEN ok THEN {pick(EVIDENCE_QUALITIES, 'effect_id + 3 * cause_id')} END AS evidence_quality,
           CASE WHEN NOT ok THEN {pick(REJECT_REASONS, f'effect_id + 3 * cause_id + {shift}')} END
             AS reject_reason
    FROM (SELECT *, ((effect_id + 2 * cause_id) % 5 < 2) <> {flip} AS ok FROM claims)"""


define("first", judged_sql(False), "claims")
define("sampled", """
    SELECT effect_id FROM (
        SELECT effect_id, n, sum(n) OVER (ORDER BY sha256('second' || effect_id)) - n AS before,
               sum(n) OVER () AS total
        FROM (SELECT effect_id, count(*) AS n FROM claims GROUP BY effect_id))
    WHERE before < 0.25 * total""", "claims")
define("second", f"""
    SELECT * FROM ({judged_sql(True)}) WHERE effect_id IN (SELECT effect_id FROM sampled)""",
       "claims", "sampled")
define("lp", """
    SELECT field, a, b, count(*) AS n FROM (
        SELECT 'decision' AS field, x.decision AS a, y.decision AS b FROM first x JOIN second y USING (claim_id)
        UNION ALL SELECT 'relation', x.relation, y.relation FROM first x JOIN second y USING (claim_id)
            WHERE x.decision = 'accept' AND y.decision = 'accept'
        UNION ALL SELECT 'reject_reason', x.reject_reason, y.reject_reason
            FROM first x JOIN second y USING (claim_id)
            WHERE x.decision = 'reject' AND y.decision = 'reject') GROUP BY ALL""", "first", "second")
define("dealt", f"""
    SELECT *, {pick(PEOPLE, 'n')} AS primary_annotator,
           CASE WHEN (n // 4) % 4 = 0 THEN {pick(PEOPLE, 'n + 1')} END AS review_annotator
    FROM (SELECT *, row_number() OVER (ORDER BY claim_id) - 1 AS n FROM claims)""", "claims")
define("assigned", """
    SELECT claim_id, effect_id, cause_id, machine_strength, primary_annotator AS who, 'primary' AS role FROM dealt
    UNION ALL SELECT claim_id, effect_id, cause_id, machine_strength, review_annotator, 'review' FROM dealt
    WHERE review_annotator IS NOT NULL""", "dealt")
define("notes", """
    SELECT claim_id, who FROM assigned WHERE (effect_id + cause_id) % 3 = 0""", "assigned")


def claims_of(spark, folder):
    return claim_view(spark, folder)


def assigned_of(spark, folder):
    dealt = R.deal(claims_of(spark, folder), PEOPLE)
    assigned = R.assignments(dealt)
    judged = dealt.filter((F.col("effect_id") + F.col("cause_id")) % 3 == 0)
    return assigned, R.assignments(judged).select("claim_id", "who")


@check("h20_claim_ids", with_("claims", """
    SELECT claim_id, effect_id, cause_id, lag_days, expansion_level,
           round(coalesce(machine_strength, -1), 9) AS machine_strength FROM claims"""))
def claim_ids(spark, folder):
    rows = claims_of(spark, folder).select(
        "claim_id", "effect_id", "cause_id", "lag_days", "expansion_level",
        F.coalesce("machine_strength", F.lit(-1.0)).alias("machine_strength"))
    return rounded(rows)


@check("c13_claim_endpoints", with_("claims", """
    SELECT claim_id, cause_id, effect_id, c.EventRootCode AS cause_type, c.day AS cause_day,
           c.Actor1Name AS cause_actor, e.EventRootCode AS effect_type, e.day AS effect_day,
           e.Actor1Name AS effect_actor
    FROM claims JOIN ev c ON c.GlobalEventID = cause_id JOIN ev e ON e.GlobalEventID = effect_id"""))
def claim_endpoints(spark, folder):
    return R.with_endpoints(claims_of(spark, folder), event_view(spark, folder))


@check("h19_suggested_relations", with_("claims", """
    SELECT claim_id, CASE WHEN cause_type = effect_type THEN 'ESCALATES' WHEN lag_days <= 3 THEN 'TRIGGERS'
           WHEN lag_days <= 21 THEN 'MOBILIZES' ELSE 'CONTRIBUTES_TO' END AS suggestion FROM claims"""))
def suggested_relations(spark, folder):
    return claims_of(spark, folder).select("claim_id", R.suggested_relation(
        F.col("cause_type"), F.col("effect_type"), F.col("lag_days")).alias("suggestion"))


@check("e12_dealt_claims", with_("dealt", """
    SELECT claim_id, primary_annotator, coalesce(review_annotator, '') AS review_annotator FROM dealt"""))
def dealt_claims(spark, folder):
    return R.deal(claims_of(spark, folder), PEOPLE).select(
        "claim_id", "primary_annotator", F.coalesce("review_annotator", F.lit("")).alias("review_annotator"))


@check("g3_reading_loads", with_("assigned", """
    SELECT who, count(*) FILTER (WHERE role = 'primary') AS primary_load,
           count(*) FILTER (WHERE role = 'review') AS review_load FROM assigned GROUP BY who"""))
def reading_loads(spark, folder):
    return R.reading_loads(assigned_of(spark, folder)[0])


@check("c11_unjudged_claims", with_("notes", """
    SELECT who, count(*) AS open, min(claim_id) AS first_claim FROM assigned a
    WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.claim_id = a.claim_id AND n.who = a.who) GROUP BY who"""))
def unjudged_claims(spark, folder):
    return R.unjudged(*assigned_of(spark, folder)).groupBy("who").agg(
        F.count("*").alias("open"), F.min("claim_id").alias("first_claim"))


@check("d33_progress", with_("notes", """
    SELECT who, count(*) AS assigned, count(*) FILTER (WHERE j) AS judged,
           count(DISTINCT effect_id) FILTER (WHERE NOT j) AS targets_left
    FROM (SELECT a.*, EXISTS (SELECT 1 FROM notes n WHERE n.claim_id = a.claim_id AND n.who = a.who) AS j
          FROM assigned a) GROUP BY who"""))
def progress(spark, folder):
    return R.progress(*assigned_of(spark, folder))


@check("e8_next_claims", with_("notes", """
    SELECT who, effect_id, claim_id, round(coalesce(machine_strength, -1), 9) AS machine_strength FROM (
        SELECT a.*, row_number() OVER (PARTITION BY who, effect_id
                   ORDER BY machine_strength DESC NULLS LAST, claim_id) AS rn FROM assigned a
        WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.claim_id = a.claim_id AND n.who = a.who))
    WHERE rn = 1"""))
def next_claims(spark, folder):
    best = R.next_claims(R.unjudged(*assigned_of(spark, folder)))
    return rounded(best.withColumn("machine_strength", F.coalesce("machine_strength", F.lit(-1.0))))


def two_readers(spark, folder):
    claims = claims_of(spark, folder)
    sampled = R.whole_group_sample(claims, "effect_id", 0.25, "second")
    return judgement_view(claims), judgement_view(sampled, "second")


@check("e16_whole_group_sample", with_("second", """
    SELECT effect_id, count(*) AS claims FROM second GROUP BY effect_id"""))
def whole_group_sample(spark, folder):
    return two_readers(spark, folder)[1].groupBy("effect_id").agg(F.count("*").alias("claims"))


@check("c21_aligned_labels", with_("lp", "SELECT field, a, b, n FROM lp"))
def aligned_labels(spark, folder):
    return R.label_pairs(*two_readers(spark, folder))


AGREE = """
    SELECT field, CAST(sum(n) AS BIGINT) AS pairs,
           round(round(sum(n) FILTER (WHERE a = b) / sum(n), 9), 4) AS observed,
           round(round((sum(n) FILTER (WHERE a = b) / sum(n) - any_value(e)) / (1 - any_value(e)), 9), 4) AS kappa
    FROM lp JOIN (SELECT field, sum(l * r) / any_value(t * t) AS e
                  FROM (SELECT field, a AS label, sum(n) AS l FROM lp GROUP BY ALL)
                  JOIN (SELECT field, b AS label, sum(n) AS r FROM lp GROUP BY ALL) USING (field, label)
                  JOIN (SELECT field, sum(n) AS t FROM lp GROUP BY field) USING (field)
                  GROUP BY field) USING (field) GROUP BY field"""


@check("d23_d24_agreement", with_("lp", AGREE))
def agreement(spark, folder):
    return R.agreement(R.label_pairs(*two_readers(spark, folder)))


@check("d23_quality_toxic_kappa", """
    WITH lp AS (SELECT 'label' AS field, quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL)
    """ + AGREE)
def quality_toxic_kappa(spark, folder):
    pairs = table(spark, folder, "labels").groupBy(
        F.lit("label").alias("field"), F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(
        F.count("*").alias("n"))
    return R.agreement(pairs)


@check("d24_specific_agreement", with_("lp", """
    SELECT label, CAST(sum(CASE WHEN a = label THEN n ELSE 0 END) AS BIGINT) AS first,
           CAST(sum(CASE WHEN b = label THEN n ELSE 0 END) AS BIGINT) AS second,
           CAST(sum(CASE WHEN a = label AND b = label THEN n ELSE 0 END) AS BIGINT) AS both,
           round(round(2 * sum(CASE WHEN a = label AND b = label THEN n ELSE 0 END)
             / (sum(CASE WHEN a = label THEN n ELSE 0 END) + sum(CASE WHEN b = label THEN n ELSE 0 END)), 9), 4)
             AS specific_agreement
    FROM lp JOIN (SELECT DISTINCT unnest([a, b]) AS label FROM lp WHERE field = 'relation')
      ON label = a OR label = b WHERE field = 'relation' GROUP BY label"""))
def specific_agreement(spark, folder):
    return R.specific_agreement(R.label_pairs(*two_readers(spark, folder)))


@check("d25_cause_recall", with_("first", """
    SELECT effect_id % 2 = 0 AS tuning, count(DISTINCT effect_id) AS seeds,
           count(*) FILTER (WHERE decision = 'accept') AS accepted,
           count(DISTINCT effect_id) FILTER (WHERE effect_id % 4 < 2) AS missed,
           round(round(count(*) FILTER (WHERE decision = 'accept') / (count(*) FILTER (WHERE decision = 'accept')
               + count(DISTINCT effect_id) FILTER (WHERE effect_id % 4 < 2)), 9), 4) AS recall
    FROM first GROUP BY 1"""))
def cause_recall(spark, folder):
    judged = judgement_view(claims_of(spark, folder))
    seeds = judged.select("effect_id").distinct()
    missed = seeds.filter("effect_id % 4 < 2")
    return R.recall(judged, missed, seeds.withColumn("tuning", F.col("effect_id") % 2 == 0))


@check("d26_judgement_profile", with_("first", """
    SELECT field, value, count(*) AS n FROM (
        SELECT unnest(['decision', 'relation', 'strength', 'evidence_quality', 'reject_reason']) AS field,
               unnest([decision, relation, CAST(strength AS VARCHAR), evidence_quality, reject_reason]) AS value
        FROM first) WHERE value IS NOT NULL GROUP BY ALL"""))
def judgement_profile(spark, folder):
    return R.judgement_profile(judgement_view(claims_of(spark, folder)),
                               ["decision", "relation", "strength", "evidence_quality", "reject_reason"])


@check("d27_fill_rates", with_("ev", """
    SELECT round(round(count(*) FILTER (WHERE Actor1Name <> '') / count(*), 9), 4) AS Actor1Name,
           round(round(count(*) FILTER (WHERE Actor2CountryCode <> '') / count(*), 9), 4) AS Actor2CountryCode,
           round(round(count(GoldsteinScale) / count(*), 9), 4) AS GoldsteinScale FROM ev"""))
def fill_rates(spark, folder):
    return R.fill_rates(event_view(spark, folder), ["Actor1Name", "Actor2CountryCode", "GoldsteinScale"])


@check("c22_coverage_gaps", with_("claims", """
    SELECT effect_id AS id, 'unexpected' AS problem FROM (SELECT DISTINCT effect_id FROM claims)
    WHERE effect_id NOT IN (SELECT cause_id FROM claims)
    UNION ALL SELECT cause_id, 'missing' FROM (SELECT DISTINCT cause_id FROM claims)
    WHERE cause_id NOT IN (SELECT effect_id FROM claims)"""))
def coverage_gaps(spark, folder):
    claims = claims_of(spark, folder)
    ids = lambda c: claims.select(F.col(c).alias("id"))
    return R.missing_ids(ids("cause_id"), ids("effect_id"), "id")


define("sheet", """
    SELECT effect_id AS target_id, 1 + effect_id % 3 AS depth, claim_id AS cand_group_id,
           1 + (effect_id + cause_id) % 9 AS event_count,
           CASE WHEN effect_id % 23 = 0 AND expansion_level = 2 THEN ''
                WHEN (effect_id + 2 * cause_id) % 5 < 2 THEN 'y' ELSE 'n' END AS accept
    FROM claims""", "claims")


def worksheet(spark, folder):
    e, c = F.col("effect_id"), F.col("cause_id")
    verdict = F.when((e % 23 == 0) & (F.col("expansion_level") == 2), "").when(
        (e + 2 * c) % 5 < 2, "y").otherwise("n")
    return claims_of(spark, folder).select(
        e.alias("target_id"), (1 + e % 3).alias("depth"), F.col("claim_id").alias("cand_group_id"),
        (1 + (e + c) % 9).alias("event_count"), verdict.alias("accept"))


@check("d21_branching_by_depth", with_("sheet", """
    , t AS (SELECT target_id, depth, bool_and(accept IN ('y', 'n', '-')) AS done, count(*) AS k,
                   count(*) FILTER (WHERE accept = 'y') AS y FROM sheet GROUP BY ALL)
    SELECT depth, count(*) AS targets, round(round(avg(k), 9), 2) AS mean_retrieved,
           round(round(avg(y), 9), 2) AS mean_accepted, quantile_cont(y, 0.5) AS median_accepted,
           min(y) AS min_accepted, max(y) AS max_accepted FROM t WHERE done GROUP BY depth"""))
def branching_by_depth(spark, folder):
    return R.branching(worksheet(spark, folder))[0]


@check("d21_branching_total", with_("sheet", """
    , t AS (SELECT target_id, depth, bool_and(accept IN ('y', 'n', '-')) AS done, count(*) AS k,
                   count(*) FILTER (WHERE accept = 'y') AS y,
                   sum(event_count) FILTER (WHERE accept = 'y') AS ev FROM sheet GROUP BY ALL)
    SELECT count(*) AS targets_judged, count(*) FILTER (WHERE k > 0) AS targets_with_candidates,
           round(round(avg(y), 9), 2) AS branching_factor, round(round(stddev_samp(y), 9), 2) AS stdev,
           avg(y) <= 4 AS gate_passed,
           CAST(floor(500 * (avg(y) + avg(y) * avg(y) + avg(y) * avg(y) * avg(y))) AS BIGINT)
             AS projected_group_edges,
           round(round(sum(ev) / sum(y), 9), 1) AS mean_events_per_accepted_group FROM t WHERE done"""))
def branching_total(spark, folder):
    return R.branching(worksheet(spark, folder))[1]


@check("f8_target_sample", with_("sheet", """
    , pick AS (SELECT target_id FROM (SELECT target_id, row_number() OVER (PARTITION BY depth
                   ORDER BY sha256('judge' || target_id), target_id) AS rn
               FROM (SELECT DISTINCT depth, target_id FROM sheet)) WHERE rn <= 8)
    SELECT target_id, depth, cand_group_id FROM sheet WHERE target_id IN (SELECT target_id FROM pick)"""))
def target_sample(spark, folder):
    return R.sampled_targets(worksheet(spark, folder), 8, "judge").select(
        "target_id", "depth", "cand_group_id")


@check("d20_candidate_profile", with_("claims", """
    SELECT count(*) AS seeds, CAST(sum(n) AS BIGINT) AS claims, quantile_cont(n, 0.5) AS median,
           round(round(avg(n), 9), 2) AS mean, max(n) AS max
    FROM (SELECT effect_id, count(*) AS n FROM claims GROUP BY effect_id)"""))
def candidate_profile(spark, folder):
    return R.candidate_profile(claims_of(spark, folder))


@check("d20_lags_and_types", with_("claims", """
    SELECT field, value, count(*) AS n FROM (
        SELECT unnest(['lag_days', 'cause_type', 'expansion_level']) AS field,
               unnest([CAST(lag_days AS VARCHAR), cause_type, CAST(expansion_level AS VARCHAR)]) AS value
        FROM claims) GROUP BY ALL"""))
def lags_and_types(spark, folder):
    return R.judgement_profile(claims_of(spark, folder), ["lag_days", "cause_type", "expansion_level"])


define("quoted", """
    SELECT f.claim_id, f.effect_id, f.cause_id, f.lag_days, f.decision, f.relation, f.strength,
           f.evidence_quality, f.reject_reason, n.docs, e.text AS etext, c.text AS ctext
    FROM first f, (SELECT count(*) AS docs FROM documents) n
    JOIN documents e ON e.doc_id = f.effect_id % n.docs JOIN documents c ON c.doc_id = f.cause_id % n.docs""", "first")


def quote_lists_of(claims, articles, docs):
    """Quotes are cut where a claim meets a text, so no text travels on with the claim."""
    e, c, at = F.col("effect_id") % docs, F.col("cause_id") % docs, F.col("effect_id")
    piece = lambda text, start, n: F.substring(F.col(text), start, F.lit(n))
    listed = [F.when(at % 19 == 0, "no such words").otherwise(F.col("first")), F.col("second"),
              F.when(at % 3 == 0, "nowhere to be found").otherwise(F.col("third"))]
    quotes = F.array(*[F.struct(F.lit(i).alias("place"), q.alias("quote")) for i, q in enumerate(listed)])
    return claims.select("claim_id", "effect_id", e.alias("e"), c.alias("c")).join(
        articles.select(F.col("article_id").alias("e"), F.col("text").alias("etext")), "e").select(
        "claim_id", "effect_id", "e", "c", piece("etext", (1 + at % 50).cast("int"), 40).alias("first"),
        piece("etext", F.lit(5), 20).alias("third")).join(
        articles.select(F.col("article_id").alias("c"), F.col("text").alias("ctext")), "c").select(
        "claim_id", "effect_id", "e", "c", "first", "third", piece("ctext", (1 + at % 30).cast("int"), 30).alias("second")).select(
        "claim_id", F.array_distinct(F.array("e", "c")).alias("article_ids"), quotes.alias("quotes"))


def quotes_of(claims, articles, docs):
    """A row for each quote."""
    return quote_lists_of(claims, articles, docs).select("claim_id", "article_ids", F.inline("quotes"))


@check("h31_h34_edge_records", with_("quoted", """
    , quotes AS (
        SELECT claim_id, effect_id % docs AS e, cause_id % docs AS c, unnest([
            {'place': 0, 'quote': CASE WHEN effect_id % 19 = 0 THEN 'no such words' ELSE substr(etext, 1 + effect_id % 50, 40) END},
            {'place': 1, 'quote': substr(ctext, 1 + effect_id % 30, 30)},
            {'place': 2, 'quote': CASE WHEN effect_id % 3 = 0 THEN 'nowhere to be found' ELSE substr(etext, 5, 20) END}]) AS q
        FROM quoted),
    spans AS (
        SELECT claim_id, q.place AS place, arg_min(strpos(d.text, q.quote) - 1, d.doc_id) AS start, min(d.doc_id) AS article_id,
               any_value(length(q.quote)) AS n
        FROM (SELECT *, unnest(list_distinct([e, c])) AS doc_id FROM quotes) x JOIN documents d ON d.doc_id = x.doc_id
        WHERE q.quote <> '' AND strpos(d.text, q.quote) > 0 GROUP BY ALL),
    f AS (SELECT claim_id, max(article_id) FILTER (place = 0) AS article_id, max(start) FILTER (place = 0) AS start,
                 max(n) FILTER (place = 0) AS n, count(DISTINCT d.source) AS outlets,
                 coalesce(string_agg(place || ':' || article_id || ':' || start || ':' || (start + n), ',' ORDER BY place)
                          FILTER (place > 0), '') AS supporting
          FROM spans JOIN documents d ON d.doc_id = article_id GROUP BY claim_id)
    SELECT claim_id, lag_days, CASE WHEN decision = 'accept' THEN 'ACCEPTED' ELSE 'REJECTED' END AS review_status,
           coalesce(relation, '') AS relation_type,
           coalesce(round(round(strength / 3, 9), 4), -1) AS final_strength,
           coalesce(reject_reason, '') AS reject_reason, coalesce(article_id, -1) AS article_id,
           CAST(coalesce(start, -1) AS INTEGER) AS start, CAST(coalesce(start + n, -1) AS INTEGER) AS "end",
           CASE WHEN decision = 'accept' THEN coalesce(supporting, '') ELSE '' END AS supporting,
           CAST(CASE WHEN decision = 'accept' AND start IS NOT NULL THEN outlets ELSE 0 END AS INTEGER) AS corroboration_count,
           CASE WHEN decision = 'accept' AND start IS NULL THEN 'evidence' ELSE '' END AS violations
    FROM quoted LEFT JOIN f USING (claim_id)"""))
def edge_records(spark, folder):
    """Claims over all documents: the primary quote and one supporting quote come from the effect's report, one
    from the cause's; some are in neither."""
    claims = checkpointed(claims_of(spark, folder))
    articles = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), "text", F.col("source").alias("outlet"))
    docs = articles.count()
    quotes = quote_lists_of(claims, articles, docs)
    judged = judgement_view(claims).drop("effect_id", "cause_id", "expansion_level")
    edges = R.edge_records(claims, judged, R.claim_evidence(R.quote_spans(quotes, articles)))
    none = {"relation_type": F.lit(""), "reject_reason": F.lit(""), "final_strength": F.lit(-1.0),
            "article_id": F.lit(-1), "start": F.lit(-1), "end": F.lit(-1)}
    spans = F.array_join(F.transform("supporting", lambda s: F.concat_ws(":", s["place"], s["article_id"], s["start"], s["end"])), ",")
    return edges.withColumns({k: F.coalesce(k, v) for k, v in none.items()}).select(
        "claim_id", "lag_days", "review_status", "relation_type", "final_strength", "reject_reason",
        "article_id", "start", "end", F.coalesce(spans, F.lit("")).alias("supporting"), "corroboration_count",
        F.array_join("violations", ",").alias("violations"))
