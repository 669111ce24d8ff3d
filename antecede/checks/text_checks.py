"""Tokenisers, screening, page extraction, near-duplicates and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import define, rounded, with_
from antecede.functions import quality as T, words as W
from antecede.operators import articles as A, similarity as S
from antecede.plans.splits import assign_splits, scope_observations
from antecede.sources.stand_ins import event_view, table


def lit(pattern: str) -> str:
    return pattern.replace("'", "''")


STOP = "', '".join(W.QUESTION_STOP.split())
TITLE_STOP = "', '".join(T.TITLE_STOP.split())
define("docs", r"""
    SELECT doc_id, text, lang, source, split_part(text, chr(10), 1) AS title FROM documents""")
define("gateparts", rf"""
    SELECT *, length(text) AS n, list_filter(string_split(text, chr(10) || chr(10)), lambda b: b <> '') AS bl,
           len(regexp_extract_all(text, '{T.SENTENCE_END}')) AS sentences,
           list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9]{{3,}}'),
                                     lambda w: w NOT IN ('{TITLE_STOP}'))) AS tt,
           regexp_extract_all(lower(text), '[a-z][a-z0-9]{{3,}}') AS bt
    FROM docs""", "docs")


@check("h4_tokenisers", with_("docs", f"""
    , w AS (SELECT doc_id, title, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM docs),
    q AS (SELECT *, list_transform(list_filter(ws, lambda x: length(x) > 2 AND x NOT IN ('{STOP}')),
              lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN x[:-2] ELSE x END) AS qt FROM w)
    SELECT doc_id, len(qt) AS question_tokens, md5(array_to_string(qt, ' ')) AS question_hash,
           len(list_distinct(list_filter(ws, lambda x: length(x) > 3))) AS content_words,
           len(list_distinct(list_filter(ws, lambda x: length(x) > 2))) AS headline_words
    FROM q"""))
def tokenisers(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.size(W.question_tokens(text)).alias("question_tokens"),
        F.md5(F.array_join(W.question_tokens(text), " ")).alias("question_hash"),
        F.size(W.content_words(text)).alias("content_words"),
        F.size(W.headline_words(text)).alias("headline_words"))


@check("h5_text_similarity", """
    WITH w AS (SELECT doc_id, source, list_distinct(list_filter(
                   regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+'),
                   lambda x: length(x) > 2)) AS a,
               list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
                   lambda x: length(x) > 2)) AS b FROM documents)
    SELECT doc_id, coalesce(round(CASE WHEN len(a) > 0 AND len(b) > 0
        THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9), -1) AS jaccard
    FROM w""")
def text_similarity(spark, folder):
    """Null-aware Jaccard of each document's first line and whole text; unknown shows as -1."""
    first = F.substring_index("text", "\n", 1)
    value = W.known_jaccard(W.headline_words(first), W.headline_words(F.col("text")))
    return rounded(table(spark, folder, "documents").select(
        "doc_id", F.coalesce(value, F.lit(-1.0)).alias("jaccard")))


@check("h23_text_quality", rf"""
    WITH d AS (SELECT doc_id, text, doc_id % 9 <> 0 AS verified,
                      CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0
                           ELSE len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+')) END AS word_count,
                      NOT regexp_matches(text, '{lit(T.PROTEST_CUES)}', 'i') AS no_cue
               FROM documents)
    SELECT doc_id, word_count,
           CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'UNSUITABLE' WHEN NOT verified THEN 'UNVERIFIED'
                WHEN word_count < 120 THEN 'SHORT_REVIEW' ELSE 'READABLE' END AS quality,
           concat_ws(',', CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'extracted' END,
                CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AND NOT verified THEN 'current-extractor-not-verified' END,
                CASE WHEN word_count < 120 THEN 'short-text-review' END,
                CASE WHEN no_cue THEN 'no-protest-cue-in-body' END) AS flags
    FROM d""")
def text_quality(spark, folder):
    docs = table(spark, folder, "documents").withColumns({
        "status": F.lit("extracted"), "reason": F.lit(None).cast("string"),
        "verified": F.col("doc_id") % 9 != 0})
    return A.text_quality(docs).select(
        "doc_id", "word_count", "quality", F.array_join("flags", ",").alias("flags"))


@check("h24_page_language", r"""
    SELECT page_id, lower(regexp_extract(html,
        '<html[^>]*\blang\s*=\s*["'']?([a-zA-Z]{2,3}(?:-[a-zA-Z0-9]+)?)', 1, 'i')) AS language
    FROM pages""")
def page_language(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", T.language(F.col("html"), F.col("html")).alias("language"))


@check("h25_page_gate", with_("gateparts", rf"""
    , m AS (SELECT *, len(tt) < 2 OR list_has_any(tt, bt) AS fits,
                   len(list_filter(bl, lambda b: length(b) < 80)) AS short_n,
                   len(list_filter(bl, lambda b: length(b) >= 200)) AS long_n,
                   len(list_filter(bl, lambda b: regexp_matches(b, '{lit(T.LISTING_DATE_CUES)}', 'i'))) AS dated,
                   len(list_filter(bl, lambda b: regexp_matches(b, '{lit(T.NAVIGATION_CUES)}', 'i'))) AS menus,
                   len(list_filter(bl, lambda b: length(b) >= 40)) AS solid,
                   title || chr(10) || text AS whole FROM gateparts)
    SELECT doc_id, CASE
        WHEN n < 1200 AND regexp_matches(whole, '{lit(T.PAYWALL_CUES)}', 'i') THEN 'paywall-cue'
        WHEN n < 1200 AND regexp_matches(whole, '{lit(T.BLOCKED_CUES)}', 'i') THEN 'blocked-page-cue'
        WHEN n < 1200 AND regexp_matches(whole, '{lit(T.ERROR_PAGE_CUES)}', 'i') THEN 'error-page-cue'
        WHEN n = 0 THEN 'no-extracted-content'
        WHEN n < 400 THEN 'less-than-400-characters'
        WHEN NOT fits THEN 'title-body-mismatch'
        WHEN (menus >= 2 AND (len(tt) = 0 OR NOT fits)) OR (len(bl) >= 20 AND long_n = 0)
          OR (len(bl) >= 8 AND dated >= 3 AND long_n <= 2)
          OR (len(bl) >= 6 AND short_n / len(bl) >= 0.75 AND sentences < 3) THEN 'navigation-only'
        WHEN solid < 2 AND sentences < 3 THEN 'insufficient-article-structure'
        WHEN n < 800 AND len(regexp_extract_all(text, '(?i){lit(T.PROMOTIONAL_CUES)}')) >= 2
            THEN 'boilerplate-only'
        WHEN regexp_matches(text, '{lit(T.PRESS_RELEASE_CUES)}', 'i') THEN 'press-release'
        WHEN len(regexp_extract_all(whole, '(?i){lit(T.PROMOTION_CUES)}')) >= 2
            THEN 'promotional-content'
        ELSE 'none' END AS reason
    FROM m"""))
def page_gate(spark, folder):
    docs = table(spark, folder, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    gate = T.page_gate(F.col("title"), F.col("text"), F.lit(""), F.lit(None).cast("string"))
    return docs.select("doc_id", F.coalesce(gate["reason"], F.lit("none")).alias("reason"))


_CUES = f"'(?i){T.PROTEST_CUES}'"


@check("h22_cue_spans", f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' A Strike and two sit-ins near here.'
                                                    WHEN 1 THEN ' PROTESTERS, not strikers' ELSE '' END AS text FROM documents),
    f AS (SELECT doc_id, regexp_extract_all(text, {_CUES}) AS m, string_split_regex(text, {_CUES}) AS g FROM d),
    i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)
    SELECT doc_id, m[i] AS text, CAST(spot AS INTEGER) AS start, CAST(spot + length(m[i]) AS INTEGER) AS "end"
    FROM (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS spot
          FROM i)""")
def cue_spans(spark, folder):
    """Cues that two documents of three end with, beside any that their texts hold."""
    n = F.col("doc_id") % 3
    ending = F.when(n == 0, " A Strike and two sit-ins near here.").when(n == 1, " PROTESTERS, not strikers").otherwise("")
    return table(spark, folder, "documents").select("doc_id", F.inline(A.cue_spans(F.concat(F.coalesce("text", F.lit("")), ending))))


@check("h26_h27_page_text")
def page_text(spark, folder):
    return A.extracted_pages(table(spark, folder, "pages"))


@check("h37_paragraphs", r"""
    WITH l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, lines,
                      unnest(lines) AS line
               FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
    o AS (SELECT doc_id, i, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i)
                 - length(line) - 1 AS BIGINT) AS off FROM l)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph_id,
           md5(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS text_hash,
           off + length(regexp_extract(line, '^(\s*)', 1)) AS start_char,
           off + length(line) - length(regexp_extract(line, '(\s*)$', 1)) AS end_char
    FROM o WHERE NOT regexp_matches(line, '^\s*$')""")
def paragraphs(spark, folder):
    p = A.paragraphs(table(spark, folder, "documents"))
    return p.select("doc_id", "paragraph_id", F.md5("text").alias("text_hash"), "start_char", "end_char")


@check("h28_publication_dates", with_("ev", """
    , p AS (SELECT GlobalEventID, event_date, CASE WHEN GlobalEventID % 17 = 0 THEN 'not a date'
                ELSE strftime(event_date + CAST(GlobalEventID % 90 AS INTEGER) - 45, '%Y-%m-%d')
                     || 'T08:00:00Z' END AS published FROM ev),
    q AS (SELECT *, TRY_CAST(published[:10] AS DATE) AS d FROM p)
    SELECT GlobalEventID,
           coalesce(strftime(CASE WHEN abs(d - event_date) <= 30 THEN d END, '%Y-%m-%d'), '') AS kept,
           CASE WHEN abs(d - event_date) > 30 THEN 'outside_event_window' ELSE '' END AS reason
    FROM q"""))
def publication_dates(spark, folder):
    moved = F.date_add("event_date", (F.col("GlobalEventID") % 90 - 45).cast("int")).cast("string")
    text = F.when(F.col("GlobalEventID") % 17 == 0, "not a date").otherwise(
        F.concat(moved, F.lit("T08:00:00Z")))
    kept, reason = T.validated_date(T.published_date(text), F.col("event_date"))
    return event_view(spark, folder).select(
        "GlobalEventID", F.coalesce(kept.cast("string"), F.lit("")).alias("kept"),
        F.coalesce(reason, F.lit("")).alias("reason"))


define("grams", r"""
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o,
                                       lead(w, 3) OVER o, lead(w, 4) OVER o) AS s
        FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n
              FROM (SELECT doc_id, regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+') AS ws FROM documents))
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= n - 4""")
define("gramcounts", "SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id", "grams")
define("duppairs", """
    SELECT p.a, p.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
        FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
    JOIN gramcounts m ON m.doc_id = p.a JOIN gramcounts n ON n.doc_id = p.b
    WHERE k / (m.n + n.n - k) >= 0.8""", "grams", "gramcounts")
define("alllinks", """
    SELECT a, b FROM duppairs
    UNION SELECT min(doc_id) OVER (PARTITION BY sha256(text)), doc_id FROM documents
          WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""", "duppairs")
REACH = """reach(node, member) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT r.node, CASE WHEN l.a = r.member THEN l.b ELSE l.a END
        FROM reach r JOIN alllinks l ON l.a = r.member OR l.b = r.member)"""


def documents(spark, folder):
    return table(spark, folder, "documents").withColumn(
        "text_hash", F.when(W.stripped(F.col("text")) != "", F.sha2("text", 256)))


@check("i1_near_duplicate_groups", with_("alllinks", """
    SELECT node AS doc_id, min(member) AS component FROM reach GROUP BY node""", REACH))
def near_duplicate_groups(spark, folder):
    """Near-duplicate links and J1 components."""
    return S.duplicate_groups(documents(spark, folder), "doc_id", "text", ["text_hash"])


@check("k7_e15_splits", with_("alllinks", """
    , comp AS (SELECT node AS doc_id, min(member) AS component FROM reach GROUP BY node),
    piloted AS (SELECT DISTINCT component FROM comp WHERE doc_id IN (
        SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1)),
    grp AS (SELECT component, count(*) AS n FROM comp
            WHERE component NOT IN (SELECT component FROM piloted) GROUP BY component),
    run AS (SELECT *, sum(n) OVER (ORDER BY sha256('splits:' || component)) - n AS before FROM grp),
    tot AS (SELECT round_even(sum(n) * 0.2, 0) AS test, round_even(sum(n) * 0.15, 0) AS dev FROM grp),
    fin AS (SELECT coalesce(max(before + n), 0) AS test_end FROM run, tot WHERE before < test)
    SELECT c.doc_id, c.component,
           CASE WHEN r.component IS NULL THEN 'pilot' WHEN before < test THEN 'test'
                WHEN before - test_end < dev THEN 'dev' ELSE 'train' END AS split
    FROM comp c LEFT JOIN run r USING (component), tot, fin""", REACH))
def splits(spark, folder):
    pilot = table(spark, folder, "labels").filter("quality = 0 AND toxic = 1")
    return assign_splits(documents(spark, folder), "doc_id", "text", ["text_hash"], pilot,
                         "splits", 0.2, 0.15)


@check("g4_scope_observations", with_("ev", """
    SELECT url_key, count(*) AS n, min(GlobalEventID) AS first_id FROM (
        SELECT DISTINCT GlobalEventID, day, EventCode, EventRootCode, ActionGeo_CountryCode,
               SOURCEURL AS url_key FROM ev
        WHERE EventRootCode IN ('14', '18') AND ActionGeo_CountryCode = 'G4'
          AND day BETWEEN 20240101 AND 20241231)
    GROUP BY url_key"""))
def scope_observations_(spark, folder):
    seen = scope_observations(event_view(spark, folder), ["14", "18"], "G4", 20240101, 20241231)
    return seen.groupBy("url_key").agg(
        F.count("*").alias("n"), F.min("GlobalEventID").alias("first_id"))


@check("i2_bm25_scores", f"""
    WITH t AS (SELECT doc_id AS node, list_transform(list_filter(
                   regexp_extract_all(lower(text), '[a-z0-9]+'),
                   lambda x: length(x) > 2 AND x NOT IN ('{STOP}')),
                   lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN x[:-2] ELSE x END) AS ts
               FROM documents),
    q AS (SELECT DISTINCT item_id AS question_id, unnest(list_transform(list_filter(
              regexp_extract_all(lower(text), '[a-z0-9]+'),
              lambda x: length(x) > 2 AND x NOT IN ('{STOP}')),
              lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN x[:-2] ELSE x END)) AS term
          FROM benchmark),
    post AS (SELECT node, len(ts) AS dl, term, count(*) AS tf
             FROM (SELECT node, ts, unnest(ts) AS term FROM t) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    s AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM t)
    SELECT question_id, node, score FROM (
        SELECT question_id, node, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
        FROM q JOIN post USING (term) JOIN df USING (term), s GROUP BY ALL) WHERE score > 0""")
def bm25(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("node"), "text")
    questions = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return S.bm25_scores(docs, questions)


@check("i3_max_cosine", """
    WITH v AS (SELECT vec_id // 10 AS owner, embedding AS e FROM embeddings),
    p AS (SELECT DISTINCT a.owner AS a, b.owner AS b FROM v a JOIN v b ON b.owner IN (a.owner + 1, a.owner + 2))
    SELECT p.a, p.b, round(max(list_dot_product(CAST(x.e AS DOUBLE[]), CAST(y.e AS DOUBLE[]))), 6) AS similarity
    FROM p JOIN v x ON x.owner = p.a JOIN v y ON y.owner = p.b GROUP BY p.a, p.b""")
def max_cosine(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("owner"), F.col("embedding").alias("vector"))
    owners = vectors.select("owner").distinct()
    ahead = owners.select(F.col("owner").alias("a"), F.explode(
        F.array(F.col("owner") + 1, F.col("owner") + 2)).alias("b"))
    pairs = ahead.join(owners.withColumnRenamed("owner", "b"), "b", "left_semi")
    return rounded(S.max_cosine(pairs, vectors), 6)


@check("i4_cosine_pairs", """
    SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b,
           round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45""")
def cosine_pairs(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("label").alias("block"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(S.cosine_pairs(vectors, 0.45), 6)
