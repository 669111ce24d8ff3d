"""Sentence ranking, retrieval metrics, span audits, freeze and label checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import define, with_
from antecede.functions.codes import CONDITION_LABELS
from antecede.operators import articles as A, evaluation as V, mentions as M, review as R
from antecede.plans.expand import expand
from antecede.session import checkpointed
from antecede.sources.stand_ins import event_view, table

define("sent", r"""
    WITH l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line,
                      regexp_replace(lines[1], '^\s+|\s+$', '', 'g') AS first_line
               FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
    o AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT)
                 AS off FROM l)
    SELECT doc_id AS article_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS sentence_id,
           regexp_replace(line, '^\s+|\s+$', '', 'g') AS text,
           CASE WHEN doc_id % 11 = 0 THEN '' ELSE first_line END AS headline,
           off + length(regexp_extract(line, '^(\s*)', 1)) AS start,
           off + length(line) - length(regexp_extract(line, '(\s*)$', 1)) AS "end"
    FROM o WHERE NOT regexp_matches(line, '^\s*$')""")
define("scoredsent", """
    WITH w AS (SELECT *, ((article_id * 7 + sentence_id * 13) % 21 - 10) / 10.0::DOUBLE AS sim,
                      ((article_id * 3 + sentence_id * 5) % 11) / 10.0::DOUBLE AS rel, trim(headline) <> '' AS titled,
                      list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)) AS tw,
                      list_distinct(list_filter(regexp_extract_all(lower(headline), '[a-z0-9]+'), lambda x: length(x) > 2)) AS hw
               FROM sent),
    s AS (SELECT *, CASE WHEN titled THEN (sim + 1) / 2 ELSE 0 END AS hs, 1 / (1 + 0.2::DOUBLE * (sentence_id - 1)) AS ps,
                 len(tw) >= 3 AND len(list_intersect(tw, hw)) / len(tw) >= 0.8 AS echo FROM w)
    SELECT article_id, sentence_id, echo, start, "end",
           row_number() OVER (PARTITION BY article_id ORDER BY echo, round((0.6::DOUBLE * hs + 0.2::DOUBLE * ps
               + 0.2::DOUBLE * rel) / CASE WHEN titled THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END, 9) DESC, sentence_id) AS rank,
           row_number() OVER (PARTITION BY article_id ORDER BY ps DESC, sentence_id) AS position_rank,
           row_number() OVER (PARTITION BY article_id ORDER BY hs DESC, sentence_id) AS headline_rank,
           count(*) OVER (PARTITION BY article_id) AS sentences
    FROM s""", "sent")
define("gold", """
    SELECT article_id, sentence_id, sentence_id = min(sentence_id) OVER (PARTITION BY article_id) AS core
    FROM sent WHERE (article_id + sentence_id) % 4 = 1""", "sent")
SPLIT = "CASE article_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"


def sentences_of(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "article_id")
    headline = F.when(F.col("article_id") % 11 == 0, "").otherwise(
        F.regexp_replace(F.substring_index("text", "\n", 1), r"^\s+|\s+$", ""))
    n, k = F.col("article_id"), F.col("paragraph_id")
    return A.paragraphs(docs, "article_id").join(docs.select("article_id", headline.alias("headline")), "article_id").select(
        "article_id", k.cast("bigint").alias("sentence_id"), "text", "headline",
        F.col("start_char").alias("start"), F.col("end_char").alias("end"),
        (((n * 7 + k * 13) % 21 - 10) / 10).alias("similarity"), (((n * 3 + k * 5) % 11) / 10).alias("event_relevance"))


def ranks_of(spark, folder):
    return V.ranked(V.with_scores(sentences_of(spark, folder)))


def gold_of(ranks):
    first = ranks.filter("(article_id + sentence_id) % 4 = 1")
    lead = first.groupBy("article_id").agg(F.min("sentence_id").alias("lead"))
    return first.join(lead, "article_id").select("article_id", "sentence_id", (F.col("sentence_id") == F.col("lead")).alias("core"))


def split_of():
    return F.when(F.col("article_id") % 5 == 0, "test").when(F.col("article_id") % 5 == 1, "dev").otherwise("train")


@check("h30_e14_sentence_ranks", with_("scoredsent", """
    SELECT article_id, sentence_id, echo, rank, position_rank, headline_rank, sentences FROM scoredsent"""))
def sentence_ranks(spark, folder):
    return ranks_of(spark, folder).select(
        "article_id", "sentence_id", "echo", "rank", "position_rank", "headline_rank", "sentences")


define("hitrows", """
    SELECT article_id, count(*) AS support, max(sentences) AS n, max(CAST(rank <= 1 AS INT)) AS top1,
           max(CAST(rank <= 3 AS INT)) AS top3, max(CAST(core AND rank <= 1 AS INT)) AS core1,
           max(CAST(core AND rank <= 3 AS INT)) AS core3,
           max(CAST(position_rank <= 1 AS INT)) AS p1, max(CAST(position_rank <= 3 AS INT)) AS p3,
           max(CAST(headline_rank <= 1 AS INT)) AS h1, max(CAST(headline_rank <= 3 AS INT)) AS h3
    FROM scoredsent JOIN gold USING (article_id, sentence_id) GROUP BY article_id""", "scoredsent", "gold")


@check("d28_d29_retrieval_report", with_("hitrows", f"""
    , r AS (SELECT *, {SPLIT} AS split, article_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS benchmark,
                   support / n AS c1, CASE WHEN n < 3 THEN 1 ELSE 1 - greatest(n - support, 0) * greatest(n - support - 1, 0)
                       * greatest(n - support - 2, 0) / (n * (n - 1) * (n - 2)) END AS c3 FROM hitrows)
    SELECT split, count(*) AS articles, count(*) FILTER (WHERE benchmark) AS benchmark_articles,
           round(avg(top1), 6) AS top1, round(avg(top3), 6) AS top3, round(avg(p1), 6) AS position1,
           round(avg(p3), 6) AS position3, round(avg(h1), 6) AS headline1, round(avg(h3), 6) AS headline3,
           round(avg(c1), 6) AS chance1, round(avg(c3), 6) AS chance3,
           round(avg(top1) FILTER (WHERE benchmark), 6) AS benchmark_top1,
           round(avg(top3) FILTER (WHERE benchmark), 6) AS benchmark_top3, round(avg(core1), 6) AS core_top1,
           round(avg(core3), 6) AS core_top3, round(avg(support), 6) AS mean_support
    FROM r GROUP BY split"""))
def retrieval_report(spark, folder):
    """B19 marks the benchmark articles."""
    ranks = checkpointed(ranks_of(spark, folder))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("article_id"), "quality")
    flag = V.is_benchmark(F.lit("REVIEWED"), F.when(F.col("quality") == 1, "PROTEST").otherwise("UNRELATED"),
                          F.lit("COMPLETE"), F.lit("INDIA_2024"))
    articles = ranks.select("article_id").distinct().join(labels, "article_id", "left").select(
        "article_id", split_of().alias("split"), flag.alias("benchmark"))
    return V.retrieval_report(V.article_hits(ranks, gold_of(ranks)), articles, "split")


@check("d30_entity_scores", with_("scoredsent", """
    , p AS (SELECT DISTINCT article_id, start, "end" FROM scoredsent WHERE rank <= 3 AND sentence_id % 3 <> 0),
    g AS (SELECT DISTINCT article_id, start, "end" FROM scoredsent WHERE sentence_id % 2 = 0)
    SELECT tp AS true_positive, np AS predicted, ng AS gold, nc AS candidate_gold, round(tp / np, 6) AS precision,
           round(tp / ng, 6) AS recall, round(tp / nc, 6) AS recall_within_candidates
    FROM (SELECT count(*) AS tp FROM p JOIN g USING (article_id, start, "end")), (SELECT count(*) AS np FROM p),
         (SELECT count(*) AS ng FROM g), (SELECT count(*) AS nc FROM scoredsent WHERE rank <= 3 AND sentence_id % 2 = 0)"""))
def entity_scores(spark, folder):
    """Whole sentences stand in for entity spans."""
    ranks = checkpointed(ranks_of(spark, folder)).withColumn("label", F.lit("EVENT"))
    top = ranks.filter(F.col("rank") <= V.TOP)
    return V.span_scores(top.filter("sentence_id % 3 <> 0"), ranks.filter("sentence_id % 2 = 0"), top)


@check("d31_span_audit", with_("sent", """
    , s AS (SELECT article_id, sentence_id, text, start + CAST(article_id % 17 = 0 AS INT) AS start, "end" FROM sent),
    a AS (SELECT s.*, substr(d.text, CAST(s.start AS BIGINT) + 1, CAST(s."end" - s.start AS BIGINT)) AS cut
          FROM s JOIN documents d ON d.doc_id = s.article_id)
    SELECT article_id, sentence_id AS span_id, 'span-text-mismatch' AS rule FROM a WHERE start >= "end" OR cut <> text"""))
def span_audit(spark, folder):
    """Spans of one article in seventeen are shifted, and must be reported."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), "text")
    shift = F.when(F.col("article_id") % 17 == 0, 1).otherwise(0)
    spans = sentences_of(spark, folder).select(
        "article_id", F.col("sentence_id").alias("span_id"), "text", (F.col("start") + shift).alias("start"), "end")
    return V.span_audit(docs, spans)


define("kept_sent", "SELECT * FROM sent WHERE NOT (article_id % 11 = 0 AND sentence_id = 2)", "sent")
define("cands", """
    SELECT article_id, sentence_id AS span_id, CAST(sentence_id AS BIGINT) + CAST(article_id % 7 = 0 AS INT) AS rank,
           start + CAST(article_id % 19 = 0 AS INT) AS start, "end" FROM sent
    WHERE sentence_id <= CASE WHEN article_id % 17 = 0 THEN 4 ELSE 3 END""", "sent")


@check("d31_article_audit", with_("kept_sent cands", r"""
    , d AS (SELECT doc_id AS article_id, text FROM documents WHERE text IS NOT NULL),
    gap AS (SELECT article_id, coalesce(max("end") OVER (PARTITION BY article_id ORDER BY start, "end"
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, start AS e FROM kept_sent
            UNION ALL SELECT d.article_id, coalesce(k.e, 0), length(text) FROM d
            LEFT JOIN (SELECT article_id, max("end") AS e FROM kept_sent GROUP BY article_id) k ON k.article_id = d.article_id),
    c AS (SELECT c.*, row_number() OVER (PARTITION BY c.article_id ORDER BY rank, span_id) AS place, k.start AS ks, k."end" AS ke
          FROM cands c LEFT JOIN kept_sent k ON k.article_id = c.article_id AND k.sentence_id = c.span_id)
    SELECT article_id, 'article-text-hash-mismatch' AS rule FROM d WHERE article_id % 13 = 0
    UNION SELECT g.article_id, 'article-text-not-covered' FROM gap g JOIN d ON d.article_id = g.article_id
      WHERE e > s AND regexp_matches(substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)), '\S')
    UNION SELECT article_id, 'too-many-candidates' FROM c WHERE place > 3
    UNION SELECT article_id, 'unknown-candidate' FROM c WHERE ks IS NULL OR ks <> start OR ke <> "end"
    UNION SELECT article_id, 'rank-mismatch' FROM c WHERE rank <> place"""))
def article_audit(spark, folder):
    """Pinned texts, coverage and candidate ranks, each wrong for a part of the articles."""
    n, k = F.col("article_id"), F.col("span_id")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), "text").filter("text is not null")
    pinned = docs.withColumn("text_sha256", F.sha2(F.when(n % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256))
    spans = checkpointed(sentences_of(spark, folder).select("article_id", F.col("sentence_id").alias("span_id"), "start", "end"))
    listed = spans.filter(k <= F.when(n % 17 == 0, 4).otherwise(3)).select(
        "article_id", "span_id", (k + F.when(n % 7 == 0, 1).otherwise(0)).alias("rank"),
        (F.col("start") + F.when(n % 19 == 0, 1).otherwise(0)).alias("start"), "end")
    return V.article_audit(pinned, spans.filter(~((n % 11 == 0) & (k == 2))), listed)


define("records", f"""
    SELECT doc_id AS article_id, {SPLIT.replace('article_id', 'doc_id')} AS split,
           CASE WHEN doc_id % 19 = 0 THEN 'UNREVIEWED' WHEN quality = 0 THEN 'UNSUITABLE' ELSE 'REVIEWED' END AS review_status,
           CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'ana' END AS reviewer,
           CASE WHEN toxic = 1 THEN 'ai_assisted' ELSE 'human' END AS label_source FROM labels""")


def records_of(spark, folder):
    n = F.col("article_id")
    return table(spark, folder, "labels").withColumnRenamed("doc_id", "article_id").select(
        n, split_of().alias("split"),
        F.when(n % 19 == 0, "UNREVIEWED").when(F.col("quality") == 0, "UNSUITABLE").otherwise("REVIEWED").alias("review_status"),
        F.when(n % 23 == 0, "").otherwise("ana").alias("reviewer"),
        F.when(F.col("toxic") == 1, "ai_assisted").otherwise("human").alias("label_source"))


@check("d38_freeze_problems", with_("records", """
    SELECT article_id, 'unreviewed' AS rule FROM records WHERE review_status = 'UNREVIEWED'
    UNION ALL SELECT article_id, 'no-reviewer' FROM records WHERE review_status = 'REVIEWED' AND reviewer = ''
    UNION ALL SELECT article_id, 'ai-label-in-gold' FROM records
        WHERE review_status = 'REVIEWED' AND label_source = 'ai_assisted'"""))
def freeze_problems(spark, folder):
    return V.freeze_problems(records_of(spark, folder), gold=True)


@check("d38_freeze_profile", with_("records", """
    SELECT split, review_status, label_source, count(*) AS articles FROM records GROUP BY ALL"""))
def freeze_profile(spark, folder):
    return V.freeze_profile(records_of(spark, folder))


@check("h40_blinded_records", with_("records", """
    SELECT article_id, split, CASE WHEN split = 'test' THEN '-' ELSE review_status END AS review_status,
           CASE WHEN split = 'test' THEN '-' ELSE label_source END AS label_source FROM records"""))
def blinded_records(spark, folder):
    hidden = V.blinded(records_of(spark, folder), ["article_id"])
    return hidden.select("article_id", "split", *[
        F.coalesce(c, F.lit("-")).alias(c) for c in ("review_status", "label_source")])


@check("b20_label_violations", with_("records", """
    SELECT article_id, 'invalid:review_status' AS rule FROM records WHERE review_status = 'UNSUITABLE'
    UNION ALL SELECT article_id, 'invalid:scope' FROM records WHERE article_id % 13 = 0
    UNION ALL SELECT article_id, 'missing:reviewer' FROM records WHERE review_status = 'REVIEWED' AND reviewer = ''
    UNION ALL SELECT article_id, 'missing:body_quality' FROM records WHERE review_status = 'REVIEWED' AND article_id % 7 = 0"""))
def label_violations(spark, folder):
    rows = records_of(spark, folder).withColumns({
        "protest_relevance": F.lit("PROTEST"),
        "scope": F.when(F.col("article_id") % 13 == 0, "MARS").otherwise("INDIA_2024"),
        "body_quality": F.when(F.col("article_id") % 7 != 0, "COMPLETE")})
    domains = {"protest_relevance": ("PROTEST", "PROTEST_LINKED", "UNRELATED", "UNCERTAIN"),
               "body_quality": ("COMPLETE", "LIMITED", "INSUFFICIENT"),
               "scope": ("INDIA_2024", "OUT_OF_SCOPE", "UNCERTAIN")}
    return R.label_violations(rows, domains, "article_id")


@check("h35_applied_labels", """
    WITH s AS (SELECT l.doc_id AS article_id, CASE WHEN quality = 0 THEN 'UNRELATED' END AS ex,
                      l.doc_id % 6 = 0 AS drop_focal, l.doc_id % 10 = 3 AS no_focal FROM labels l)
    SELECT d.doc_id AS article_id, CASE WHEN ex IS NOT NULL OR (drop_focal AND NOT no_focal) THEN 'UNSUITABLE'
           ELSE 'REVIEWED' END AS review_status,
           coalesce(ex, CASE WHEN drop_focal AND NOT no_focal THEN 'NO_FOCAL_EVENT' END, '') AS exclusion
    FROM documents d JOIN s ON s.article_id = d.doc_id""")
def applied_labels(spark, folder):
    articles = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), F.lit(9).alias("sentences"))
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "article_id")
    screening = labels.select("article_id", F.when(F.col("quality") == 0, "UNRELATED").alias("exclusion_reason"),
                              F.lit("").alias("reason"))
    focal = labels.filter("article_id % 10 <> 3").select(
        "article_id", F.when(F.col("article_id") % 6 == 0, "UNSUITABLE").otherwise("FOCAL").alias("decision"),
        F.lit(None).cast("string").alias("focal_reason"), F.array(F.lit(1)).alias("support"), F.lit(1).alias("core"))
    return V.applied_labels(articles, screening, focal)[0].withColumn("exclusion", F.coalesce("exclusion", F.lit("")))


@check("h32_applied_extraction", with_("sent", """
    , e AS (SELECT article_id, sentence_id, text, start, split_part(text, ' ', 1) AS w1, split_part(text, ' ', 2) AS w2
            FROM sent)
    SELECT article_id, sentence_id, strpos(text, w1) > 0 AND w1 <> '' AS kept,
           CASE WHEN w1 = '' THEN 0 ELSE CAST(w2 = '' AS INT) + 1 END AS dropped,
           CASE WHEN w2 = '' THEN 0 ELSE 1 END AS holders FROM e"""))
def applied_extraction(spark, folder):
    """Each sentence's first word is the condition, its second a holder, beside one holder
    that is not in the text."""
    sentences = checkpointed(sentences_of(spark, folder).withColumnRenamed("start", "start_char"))
    word = lambda i: F.coalesce(F.get(F.split("text", " "), i), F.lit(""))
    entries = sentences.select("article_id", "sentence_id", F.array(word(1), F.lit("zz not there")).alias("holders"),
                               word(0).alias("condition"))
    out = M.applied_extraction(entries, sentences, ["holders"], ["condition"], "condition")
    return out.select("article_id", "sentence_id", "kept", "dropped", F.size("holders_spans").alias("holders"))


@check("h33_applied_review", with_("ev", """
    , m AS (SELECT GlobalEventID AS id, GlobalEventID // 3 AS art, GlobalEventID % 3 AS s, GlobalEventID % 5 <> 0 AS ok FROM ev),
    f AS (SELECT *, ok AND s = (SELECT min(x.s) FROM m x WHERE x.art = m.art) AS lead FROM m)
    SELECT id AS mention_id, CASE WHEN ok THEN 'REVIEWED' ELSE 'REJECTED' END AS review_status,
           ok AND id % 2 = 0 AS corrected, lead AS focal FROM f"""))
def applied_review(spark, folder):
    n = F.col("GlobalEventID")
    proposals = event_view(spark, folder).select(
        n.alias("mention_id"), F.floor(n / 3).alias("article_id"), (n % 3).alias("sentence_id"),
        F.lit(0).alias("evidence_start"), F.col("EventRootCode").alias("event_type"), F.lit("asserted").alias("status"),
        F.array("Actor1Name").alias("actors"), F.lit(True).alias("focal"))
    verdicts = proposals.select(
        "mention_id", F.when(F.col("mention_id") % 5 != 0, "accept").otherwise("reject").alias("verdict"),
        F.lit("unclear").alias("reason"), "event_type",
        F.when(F.col("mention_id") % 2 == 0, "announced").otherwise("asserted").alias("status"), "actors")
    out = M.applied_review(proposals, verdicts, proposals.filter("false"))
    return out.select("mention_id", "review_status", "corrected", "focal")


@check("j20_expansion_levels")
def expansion_levels(spark, folder):
    """Three levels of cause scoring from the day's seeds, following the best five candidates."""
    from antecede.operators import dashboard as D, precedence as P

    events = checkpointed(P.low_in_degree(event_view(spark, folder)))
    seeds = D.daily_seeds(events).select("GlobalEventID").distinct()
    return expand(events, seeds)


@check("h35_label_problems", """
    SELECT d.doc_id AS article_id, 'no-screening-decision' AS rule FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
    UNION ALL SELECT doc_id, 'no-focal-decision' FROM labels JOIN (SELECT doc_id FROM documents) USING (doc_id)
      WHERE quality <> 0 AND doc_id % 10 = 3
    UNION ALL SELECT doc_id, 'support-not-in-article' FROM labels JOIN (SELECT doc_id FROM documents) USING (doc_id)
      WHERE quality <> 0 AND doc_id % 10 <> 3 AND doc_id % 6 <> 0 AND doc_id % 8 = 1""")
def label_problems(spark, folder):
    """Articles without a decision, and supports that lie beyond the article."""
    n = F.col("article_id")
    articles = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), F.lit(9).alias("sentences"))
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "article_id")
    screening = labels.select("article_id", F.when(F.col("quality") == 0, "UNRELATED").alias("exclusion_reason"), F.lit("").alias("reason"))
    focal = labels.filter(n % 10 != 3).select(
        "article_id", F.when(n % 6 == 0, "UNSUITABLE").otherwise("FOCAL").alias("decision"), F.lit(None).cast("string").alias("focal_reason"),
        F.array(F.lit(1), F.when(n % 8 == 1, 12).otherwise(2)).alias("support"), F.lit(1).alias("core"))
    return V.applied_labels(articles, screening, focal)[1]


@check("h32_condition_labels", """
    SELECT vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 'ongoing' WHEN 1 THEN 'ended' ELSE 'unclear' END AS status,
           CASE WHEN label % 3 = 0 THEN 'shortage' WHEN label % 3 = 1 THEN 'policy' ELSE 'other' END AS kind,
           CASE WHEN vec_id % 5 = 0 THEN 'protest_cause' ELSE 'context' END AS role FROM embeddings""")
def condition_labels(spark, folder):
    """Labels outside their lists, or missing, become the default."""
    n, k = F.col("vec_id"), F.col("label")
    rows = table(spark, folder, "embeddings").select(
        n.alias("id"), F.when(n % 4 == 0, "ongoing").when(n % 4 == 1, "ended").when(n % 4 == 2, "paused").alias("status"),
        F.when(k % 3 == 0, "shortage").when(k % 3 == 1, "policy").otherwise("SHORTAGE").alias("kind"),
        F.when(n % 5 == 0, "protest_cause").when(n % 5 == 1, "cause").otherwise("context").alias("role"))
    return M.with_known_labels(rows, CONDITION_LABELS)


@check("h33_added_mentions", with_("ev", """
    , m AS (SELECT GlobalEventID AS id, GlobalEventID // 3 AS art, GlobalEventID % 3 AS s, GlobalEventID % 5 <> 0 AS ok FROM ev),
    a AS (SELECT id, art, s, ok, false AS extra FROM m UNION ALL SELECT -1 - id, art, 0, true, true FROM m WHERE s = 1),
    lead AS (SELECT *, row_number() OVER (PARTITION BY art ORDER BY ok AND s = f DESC, s, extra, id) AS rn
             FROM (SELECT a.*, min(s) FILTER (NOT extra) OVER (PARTITION BY art) AS f FROM a))
    SELECT id AS mention_id, CASE WHEN ok THEN 'REVIEWED' ELSE 'REJECTED' END AS review_status, ok AND s = f AND rn = 1 AS focal FROM lead"""))
def added_mentions(spark, folder):
    """Each article's reviewer adds a mention to its first sentence, behind the proposed one."""
    n = F.col("GlobalEventID")
    proposals = checkpointed(event_view(spark, folder).select(
        n.alias("mention_id"), F.floor(n / 3).alias("article_id"), (n % 3).alias("sentence_id"), F.lit(0).alias("evidence_start"),
        F.col("EventRootCode").alias("event_type"), F.lit("asserted").alias("status"), F.array("Actor1Name").alias("actors"),
        F.lit(True).alias("focal")))
    verdicts = proposals.select("mention_id", F.when(F.col("mention_id") % 5 != 0, "accept").otherwise("reject").alias("verdict"),
                                F.lit("unclear").alias("reason"), "event_type", "status", "actors")
    added = proposals.filter("sentence_id = 1").withColumns({
        "mention_id": -1 - F.col("mention_id"), "sentence_id": F.lit(0).cast("long"), "evidence_start": F.lit(5)})
    return M.applied_review(proposals, verdicts, added).select("mention_id", "review_status", "focal")
