"""Article text jobs: screening, page extraction, paragraphs, cue spans."""

from __future__ import annotations

import html as html_entities
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from antecede.functions import quality as T
from antecede.functions.words import stripped

BLOCK_TAGS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|section|article|blockquote)\b[^>]*>"
FURNITURE = r"(?is)<(nav|header|footer|aside|form)\b[^>]*>.*?</\1>"


def spans_of(text: Column, pattern: str) -> Column:
    """Every match with its zero-based start and end, end excluded.

    The text is cut at the matches; running lengths of pieces and matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(
        m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<text:string,start:int,end:int>>").alias("spans"))

    def step(state: Column, item: Column) -> Column:
        begin = state["at"] + item["g"]
        end = begin + F.length(item["m"])
        span = F.struct(item["m"].alias("text"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(steps, start, step)["spans"]


def cue_spans(text: Column) -> Column:
    return spans_of(text, f"(?i){T.PROTEST_CUES}")


def paragraphs(articles: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line, trimmed, numbered in order, with offsets."""
    lines = articles.select(key, F.posexplode(spans_of(F.col(text), "[^\r\n]+")).alias("line", "s"))
    lead = F.length(F.regexp_extract("s.text", r"^(\s*)", 1))
    tail = F.length(F.regexp_extract("s.text", r"(\s*)$", 1))
    kept = lines.filter(~F.col("s.text").rlike(r"^\s*$"))
    whole = kept.select(key, "line", F.regexp_replace("s.text", r"^\s+|\s+$", "").alias("text"),
                        (F.col("s.start") + lead).alias("start_char"),
                        (F.col("s.end") - tail).alias("end_char"))
    numbered = whole.groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("line", "text", "start_char", "end_char"))).alias("p"))
    return numbered.select(key, F.posexplode("p").alias("i", "p")).select(
        key, (F.col("i") + 1).alias("paragraph_id"), "p.text", "p.start_char", "p.end_char")


def text_quality(articles: DataFrame, short_words: int = 120) -> DataFrame:
    """Screening status and flags.

    ``articles`` has (text, status, reason, verified): the extraction outcome and whether the
    current extractor has confirmed it."""
    text = F.coalesce("text", F.lit(""))
    words = F.when(stripped(text) == "", 0).otherwise(F.size(F.split(stripped(text), r"\s+")))
    unsuitable = (F.col("status") != "extracted") | (stripped(text) == "")
    short = words < short_words
    flags = F.array_compact(F.array(
        F.when(unsuitable, F.coalesce("reason", "status")),
        F.when(~unsuitable & ~F.col("verified"), "current-extractor-not-verified"),
        F.when(short, "short-text-review"),
        F.when(~text.rlike(f"(?i){T.PROTEST_CUES}"), "no-protest-cue-in-body"),
        F.when(F.col("reason").isin("press-release", "promotional-content"), F.col("reason")),
    ))
    quality = (
        F.when(unsuitable, "UNSUITABLE").when(~F.col("verified"), "UNVERIFIED")
        .when(short, "SHORT_REVIEW").otherwise("READABLE"))
    return articles.withColumns({"quality": quality, "flags": flags, "word_count": words})


def unescaped(text: Column) -> Column:
    """Replace character entities, which no built-in function does. The function is defined
    here so that it travels to the workers by value."""
    @F.pandas_udf(StringType())
    def unescape(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield batch.map(html_entities.unescape, na_action="ignore")

    return unescape(text)


def visible_text(html: Column) -> Column:
    """A page's text with block tags as line breaks, entities still escaped."""
    content = F.regexp_replace(html, f"(?is){T.NON_CONTENT}|<!--.*?-->", " ")
    lined = F.regexp_replace(content, BLOCK_TAGS, "\n")
    return F.regexp_replace(lined, "<[^>]+>", " ")


def paragraph_text(html: Column) -> Column:
    """Only what stands in paragraphs outside page furniture."""
    content = F.regexp_replace(html, f"(?is){T.NON_CONTENT}|<!--.*?-->", " ")
    body = F.regexp_replace(content, FURNITURE, " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.regexp_replace(F.array_join(found, "\n"), "<[^>]+>", " ")


def extracted_pages(pages: DataFrame) -> DataFrame:
    """Title, cleaned text and gate result of every page (page_id, url, html).

    The strict text (paragraphs only) stands when it passes or meets a gate; else the whole
    visible text is tried, and the better of the two is kept."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    # One Python pass unescapes every text, joined by a character no page text holds.
    mark = "\u0000"
    raw = F.concat_ws(mark, title, paragraph_text(F.col("html")), visible_text(F.col("html")))
    parts = pages.withColumn("raw", F.split(unescaped(raw), mark)).select(
        "page_id", "url", F.col("html"),
        T.squeezed(F.col("raw")[0]).alias("title"), F.col("raw")[1].alias("strict"),
        F.col("raw")[2].alias("loose"))

    texts = parts.withColumn("signal", T.squeezed(F.col("loose")))
    for column in ("strict", "loose"):
        texts = T.with_clean_text(texts, column, "title", f"{column}_text")
    gated = texts.withColumns({
        "strict_gate": T.page_gate(F.col("title"), F.col("strict_text"), F.col("signal"), F.col("url")),
        "loose_gate": T.page_gate(F.col("title"), F.col("loose_text"), F.col("signal"), F.col("url")),
    })
    rank = lambda g: (
        F.when(F.col(f"{g}.status") == "extracted", 4)
        .when(F.col(f"{g}.status").isin("paywall", "blocked"), 3).otherwise(2))
    strict_wins = (
        (rank("strict_gate") >= 3)
        | ((rank("loose_gate") < 4) & (
            (rank("strict_gate") > rank("loose_gate"))
            | ((rank("strict_gate") == rank("loose_gate"))
               & (F.length("strict_text") >= F.length("loose_text"))))))
    pick = lambda a, b: F.when(strict_wins, F.col(a)).otherwise(F.col(b))
    text = pick("strict_text", "loose_text")
    return gated.select(
        "page_id", "url", "title", text.alias("text"),
        pick("strict_gate", "loose_gate")["status"].alias("status"),
        pick("strict_gate", "loose_gate")["reason"].alias("reason"),
        T.language(F.col("html"), text).alias("language"))
