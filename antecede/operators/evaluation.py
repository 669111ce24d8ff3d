"""Sentence ranking, retrieval metrics, span audits and label checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.words import headline_words

# Fixed values of the default ranking.
HEADLINE_WEIGHT, POSITION_WEIGHT, EVENT_WEIGHT = 0.6, 0.2, 0.2
POSITION_DECAY = 0.2
ECHO_OVERLAP = 0.8
ECHO_MIN_WORDS = 3
TOP = 3


def is_echo(text: Column, headline: Column, overlap: float = ECHO_OVERLAP) -> Column:
    """Most of the sentence's words are headline words: it adds nothing to the headline."""
    words = headline_words(text)
    shared = F.size(F.array_intersect(words, headline_words(headline)))
    return (F.size(words) >= ECHO_MIN_WORDS) & (shared / F.size(words) >= overlap)


def with_scores(sentences: DataFrame, drop_echoes: bool = True) -> DataFrame:
    """Add position, headline and importance scores and the echo flag.

    ``sentences`` has (article_id, sentence_id, text, headline, similarity, event_relevance)
    with sentence ids counting from 1. Without a headline its weight is left out."""
    titled = F.trim(F.coalesce("headline", F.lit(""))) != ""
    near = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity"))) + 1) / 2
    headline = F.when(titled, near).otherwise(0.0)
    position = 1 / (1 + POSITION_DECAY * (F.col("sentence_id") - 1))
    weight = POSITION_WEIGHT + EVENT_WEIGHT + F.when(titled, HEADLINE_WEIGHT).otherwise(0.0)
    importance = (HEADLINE_WEIGHT * headline + POSITION_WEIGHT * position
                  + EVENT_WEIGHT * F.col("event_relevance")) / weight
    echo = is_echo(F.col("text"), F.col("headline")) if drop_echoes else F.lit(False)
    return sentences.withColumns({
        "headline_score": headline, "position_score": position,
        "importance": F.round(importance, 9), "echo": F.coalesce(echo, F.lit(False))})


def ranked(scored: DataFrame) -> DataFrame:
    """Place of each sentence of an article under the ranking and the two baselines.

    Articles are short, so a window per article never grows with the corpus."""
    article = Window.partitionBy("article_id")
    return scored.withColumns({
        "rank": F.row_number().over(article.orderBy("echo", F.desc("importance"), "sentence_id")),
        "position_rank": F.row_number().over(article.orderBy(F.desc("position_score"), "sentence_id")),
        "headline_rank": F.row_number().over(article.orderBy(F.desc("headline_score"), "sentence_id")),
        "sentences": F.count("*").over(article),
    })


def chance_top(support: Column, sentences: Column, k: int = TOP) -> Column:
    """Chance that a random ranking puts a supporting sentence in the first ``k``."""
    misses = F.lit(1.0)
    for i in range(k):
        misses = misses * F.greatest(sentences - support - i, F.lit(0)) / F.greatest(sentences - i, F.lit(1))
    return F.when(sentences == 0, 0.0).when(sentences < k, 1.0).otherwise(1 - misses)


def article_hits(ranks: DataFrame, gold: DataFrame) -> DataFrame:
    """Per article: whether each ranking finds a supporting or the core sentence.

    ``gold`` has (article_id, sentence_id, core) rows, one per supporting sentence."""
    rows = ranks.join(gold, ["article_id", "sentence_id"])
    within = lambda c, k: F.max(F.when(F.col(c) <= k, 1).otherwise(0))
    core = lambda k: F.max(F.when(F.col("core") & (F.col("rank") <= k), 1).otherwise(0))
    return rows.groupBy("article_id").agg(
        F.count("*").alias("support"), F.max("sentences").alias("sentences"),
        within("rank", 1).alias("top1"), within("rank", TOP).alias("top3"),
        core(1).alias("core1"), core(TOP).alias("core3"), F.max(F.col("core").cast("int")).alias("has_core"),
        within("position_rank", 1).alias("position1"), within("position_rank", TOP).alias("position3"),
        within("headline_rank", 1).alias("headline1"), within("headline_rank", TOP).alias("headline3"),
    ).withColumns({
        "chance1": F.col("support") / F.col("sentences"),
        "chance3": chance_top(F.col("support"), F.col("sentences"))})


def retrieval_report(hits: DataFrame, articles: DataFrame, by: str) -> DataFrame:
    """Mean hits per group, beside the baselines, the chance floor and the protest subset.

    ``articles`` has (article_id, the group, benchmark flag)."""
    rows = hits.join(articles, "article_id")
    mean = lambda c: F.round(F.avg(c), 6)
    only = lambda c, flag: F.round(F.avg(F.when(F.col(flag).cast("boolean"), F.col(c))), 6)
    names = ["top1", "top3", "position1", "position3", "headline1", "headline3", "chance1", "chance3"]
    return rows.groupBy(by).agg(
        F.count("*").alias("articles"), F.count_if("benchmark").alias("benchmark_articles"),
        *[mean(n).alias(n) for n in names], only("top1", "benchmark").alias("benchmark_top1"),
        only("top3", "benchmark").alias("benchmark_top3"), only("core1", "has_core").alias("core_top1"),
        only("core3", "has_core").alias("core_top3"), mean(F.col("support")).alias("mean_support"))


def is_benchmark(reviewed: Column, relevance: Column, body: Column, scope: Column) -> Column:
    return F.coalesce(
        (reviewed == "REVIEWED") & relevance.isin("PROTEST", "PROTEST_LINKED") & (body == "COMPLETE")
        & (scope == "INDIA_2024"), F.lit(False))


def span_scores(predicted: DataFrame, gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entity precision and recall by exact (article, label, start, end), and recall among the
    gold spans lying inside a candidate sentence."""
    key = ["article_id", "label", "start", "end"]
    p, g = predicted.select(*key).distinct(), gold.select(*key).distinct()
    inside = g.join(
        candidates.select("article_id", F.col("start").alias("s"), F.col("end").alias("e")), "article_id"
    ).filter("s <= start AND end <= e").select(*key).distinct()
    many = lambda df: df.agg(F.count("*")).scalar()
    row = p.agg(F.count("*").alias("predicted")).withColumns({
        "true_positive": many(p.join(g, key, "left_semi")), "gold": many(g), "candidate_gold": many(inside)})
    rate = lambda d: F.round(F.try_divide(F.col("true_positive"), F.col(d)), 6)
    return row.withColumns({"precision": rate("predicted"), "recall": rate("gold"),
                            "recall_within_candidates": rate("candidate_gold")})


def span_audit(articles: DataFrame, spans: DataFrame) -> DataFrame:
    """(article_id, span_id, rule) for spans whose offsets do not give their text, that repeat
    an id, or that start before the one before ends."""
    order = Window.partitionBy("article_id").orderBy("span_id", "start")
    cut = F.substring(F.col("article_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    valid = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (
        F.col("end") <= F.length("article_text")) & (cut == F.col("text"))
    checked = spans.withColumns({
        "before": F.lag("end").over(order), "last_id": F.lag("span_id").over(order),
    }).join(articles.select("article_id", F.col("text").alias("article_text")), "article_id")
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(valid, F.lit(False)), "span-text-mismatch"),
        F.when(F.col("span_id") == F.col("last_id"), "duplicate-id"),
        F.when(F.col("start") < F.col("before"), "out-of-order")))
    return checked.select("article_id", "span_id", F.explode(rules).alias("rule"))


def article_audit(articles: DataFrame, spans: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """(article_id, rule) that a record breaks as a whole: a text that is not the pinned one, words outside all spans, and
    candidate sentences that are too many, unknown, repeated or out of rank.

    ``articles`` has (article_id, text, text_sha256), ``spans`` (article_id, span_id, start, end) and ``candidates``
    (article_id, span_id, rank, start, end). An article's spans are ordered in one group: a few hundred."""
    texts = articles.select("article_id", F.col("text").alias("article_text"), "text_sha256")
    pinned = texts.filter(~F.sha2("article_text", 256).eqNullSafe(F.col("text_sha256"))).select(
        "article_id", F.lit("article-text-hash-mismatch").alias("rule"))
    order = Window.partitionBy("article_id").orderBy("start", "end")
    ends = spans.withColumn("until", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gaps = ends.select("article_id", F.col("until").alias("s"), F.col("start").alias("e"))
    last = texts.select("article_id", F.length("article_text").alias("e")).join(
        spans.groupBy("article_id").agg(F.max("end").alias("s")), "article_id", "left").select(
        "article_id", F.coalesce("s", F.lit(0)).alias("s"), "e")
    words = F.substring(F.col("article_text"), F.col("s") + 1, F.col("e") - F.col("s")).rlike(r"\S")
    bare = gaps.unionByName(last).filter("e > s").join(texts, "article_id").filter(words).select(
        "article_id", F.lit("article-text-not-covered").alias("rule"))
    ids = spans.groupBy("article_id", "span_id").agg(F.count("*").alias("times"), F.min(F.struct("start", "end")).alias("own"))
    place = F.row_number().over(Window.partitionBy("article_id").orderBy("rank", "span_id"))
    listed = candidates.withColumns({
        "place": place, "listings": F.count("*").over(Window.partitionBy("article_id", "span_id"))}).join(
        ids, ["article_id", "span_id"], "left")
    rules = F.array_compact(F.array(
        F.when(F.col("place") > most, "too-many-candidates"),
        F.when(F.col("times").isNull() | (F.col("own") != F.struct("start", "end")), "unknown-candidate"),
        F.when((F.col("times") > 1) | (F.col("listings") > 1), "ambiguous-candidate"),
        F.when(F.col("rank") != F.col("place"), "rank-mismatch")))
    return pinned.unionByName(bare).unionByName(listed.select("article_id", F.explode(rules).alias("rule"))).distinct()


def blinded(records: DataFrame, snapshot: Sequence[str], split: str = "split") -> DataFrame:
    """Null every column of a test record that is not part of its frozen snapshot, so a field
    nobody thought of cannot leak a draft to its reviewer."""
    kept = {*snapshot, split}
    return records.select(*[
        F.col(c) if c in kept else F.when(F.col(split) != "test", F.col(c)).alias(c) for c in records.columns])


def freeze_problems(records: DataFrame, gold: bool) -> DataFrame:
    """(article_id, rule) that forbid freezing: unreviewed records, reviewed ones without a
    reviewer or a known label source, and AI labels in a set called gold."""
    status, source = F.col("review_status"), F.col("label_source")
    reviewed = status == "REVIEWED"
    rules = F.array_compact(F.array(
        F.when(status == "UNREVIEWED", "unreviewed"),
        F.when(reviewed & (F.trim(F.coalesce("reviewer", F.lit(""))) == ""), "no-reviewer"),
        F.when(reviewed & ~F.coalesce(source.isin("human", "ai_assisted"), F.lit(False)), "no-label-source"),
        F.when(F.lit(gold) & reviewed & (source == "ai_assisted"), "ai-label-in-gold")))
    return records.select("article_id", F.explode(rules).alias("rule"))


def freeze_profile(records: DataFrame) -> DataFrame:
    return records.groupBy("split", "review_status", "label_source").agg(F.count("*").alias("articles"))


def applied_labels(articles: DataFrame, screening: DataFrame, focal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles with their screening and focal decisions, and (article_id, rule) problems.

    ``screening`` has (article_id, exclusion_reason, reason); ``focal`` has (article_id,
    decision, focal_reason, support, core); ``articles`` has (article_id, sentences)."""
    screened = screening.withColumn("screened", F.lit(True))
    decided = focal.withColumn("decided", F.lit(True))
    rows = articles.join(screened, "article_id", "left").join(decided, "article_id", "left")
    excluded = F.col("exclusion_reason").isNotNull()
    dropped = excluded | (F.col("decision") == "UNSUITABLE")
    labelled = rows.filter("screened").withColumns({
        "review_status": F.when(F.coalesce(dropped, F.lit(False)), "UNSUITABLE").otherwise("REVIEWED"),
        "exclusion": F.coalesce("exclusion_reason", F.when(
            F.col("decision") == "UNSUITABLE", F.coalesce("focal_reason", F.lit("NO_FOCAL_EVENT")))),
    }).select("article_id", "review_status", "exclusion")
    kept = F.col("screened") & ~excluded & (F.coalesce("decision", F.lit("")) != "UNSUITABLE")
    support = F.coalesce("support", F.array().cast("array<int>"))
    bad_support = (F.size(support) == 0) | F.exists(support, lambda s: s > F.col("sentences")) | ~F.coalesce(
        F.array_contains(support, F.col("core")), F.lit(False))
    rules = F.array_compact(F.array(
        F.when(F.col("screened").isNull(), "no-screening-decision"),
        F.when(kept & F.col("decided").isNull(), "no-focal-decision"),
        F.when(kept & F.col("decided") & bad_support, "support-not-in-article")))
    return labelled, rows.select("article_id", F.explode(rules).alias("rule"))
