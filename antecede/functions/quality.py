"""Language, text quality and page-gate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- Fixed values: cue patterns and limits -----------------------------------------------
PROTEST_CUES = (
    r"\b(?:protests?|protested|protesting|protesters?|demonstrations?|demonstrators?|"
    r"strikes?|striking|hunger strikes?|boycotts?|boycotting|dharnas?|bandhs?|"
    r"sit[ -]ins?|agitations?|picketing)\b"
)
PAYWALL_CUES = (
    r"subscribe to continue|subscribe to read|sign in to read|premium content|for subscribers|"
    r"become a subscriber|membership required|unlock this article|this article is for subscribers"
)
BLOCKED_CUES = (
    r"access denied|verify you are human|checking your browser|enable javascript|bot detection|"
    r"unusual traffic|temporarily unavailable|captcha"
)
ERROR_PAGE_CUES = (
    r"\b(?:403|404|410|500)\b|page not found|not found|page doesn['’]?t exist|"
    r"article unavailable|content not available|error loading|server error|"
    r"requested page could not be found"
)
PROMOTIONAL_CUES = (
    r"subscribe to our newsletter|download our app|follow us on|advertisement|sponsored content|"
    r"read more stories|sign up for our newsletter"
)
PRESS_RELEASE_CUES = (
    r"\bprnewswire\b|\bnewsvoir\b|press release|advertorial disclaimer|"
    r"provided by [a-z0-9 .&-]+(?:\. | )?(?:press release|newsvoir|prnewswire)|"
    r"will not be responsible in any way for the content"
)
PROMOTION_CUES = (
    r"\bpromotion\b|\bpromotional\b|at exceptional value|visit your nearest|shop now|buy now|"
    r"special offer|exclusive offer|don't miss this opportunity|soft opening|luxurious retreat|"
    r"guest rooms|welcoming guests|scheduled to open its doors|promises a tranquil escape|"
    r"we are delighted to bring"
)
PRESS_RELEASE_URL = r"/(?:press-release|press_release)(?:/|$)"
ARTICLE_METADATA_CUES = (
    r"\b(?:ist|prnewswire|newsvoir)\b|\b(?:january|february|march|april|may|june|july|august|"
    r"september|october|november|december)\b"
)
LISTING_DATE_CUES = (
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|"
    r"december)\s+\d{1,2},\s+\d{4}\b|\b\d{1,2}:\d{2}\s*[ap]\.m\."
)
NAVIGATION_CUES = (
    r"\b(?:search|channels|recommended for you|skip to main content|latest comments|"
    r"post your comment|comments not available)\b"
)
SECTION_CUES = (
    r"\b(?:latest comments|post your comment|comments not available)\b|"
    r"support our journalism|latest news \(click title to read article\)|"
    r"latest articles \(click title to read\)|most read articles \(click title to read\)|"
    r"important notice|© copyright|subscribe to our newsletter|download our app|"
    r"follow us on|read more stories"
)
STANDALONE_NOISE = (
    r"^(?:listen to this article|listen|read more|share this page|newsletters|contact us|"
    r"submit content|advertising)\.?$"
)
TITLE_STOP = (
    "about after against among before being between could deal first from have into latest more "
    "most news over report reports says said signs signed some than that their there these they "
    "this through under what when where which while with would article announced announcement "
    "announces agreement equipment network networks"
)
SENTENCE_END = r"[.!?。！？](\s|$)"
HTML_LANG = r"<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3}(?:-[a-zA-Z0-9]+)?)"
NON_CONTENT = r"<(script|style|noscript|template|svg)\b[^>]*>.*?</\1>"
# Unicode ranges of scripts, by the label given to a text mostly in that script.
SCRIPT_RANGES = (
    ("hi/mr/ne (devanagari)", r"\x{0900}-\x{097F}"), ("bn", r"\x{0980}-\x{09FF}"),
    ("pa", r"\x{0A00}-\x{0A7F}"), ("gu", r"\x{0A80}-\x{0AFF}"), ("or", r"\x{0B00}-\x{0B7F}"),
    ("ta", r"\x{0B80}-\x{0BFF}"), ("te", r"\x{0C00}-\x{0C7F}"), ("kn", r"\x{0C80}-\x{0CFF}"),
    ("ml", r"\x{0D00}-\x{0D7F}"), ("ur/ar", r"\x{0600}-\x{06FF}"),
)
MIN_ARTICLE_CHARS = 400
MIN_ARTICLE_BLOCKS = 2
MIN_SENTENCES = 3
MAX_GATE_CHARS = 1200
SCRIPT_SHARE = 0.20


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?i){pattern}"))


def blocks_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n"), lambda b: b != "")


def count_where(items: Column, condition) -> Column:
    return F.size(F.filter(items, condition))


def language(html: Column, text: Column) -> Column:
    """The page's own language attribute, else the script holding over a fifth of the text, else
    English; unknown without text. The whole page and text are judged."""
    tag = F.lower(F.regexp_extract(html, f"(?i){HTML_LANG}", 1))
    sample = F.coalesce(text, F.lit(""))
    counts = [
        F.struct(F.regexp_count(sample, F.lit(f"[{chars}]")).alias("n"),
                 F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, chars) in enumerate(SCRIPT_RANGES)
    ]
    lead = F.greatest(*counts)
    return (
        F.when(tag != "", tag)
        .when(F.length(sample) == 0, "unknown")
        .when(lead["n"] / F.length(sample) > SCRIPT_SHARE, lead["name"])
        .otherwise("en")
    )


def title_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(TITLE_STOP.split())))


def title_matches_body(title: Column, text: Column) -> Column:
    """A title of two or more telling words must share one with the body."""
    telling = title_tokens(title)
    body = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]{3,}"), F.lit(0))
    return (F.size(telling) < 2) | F.arrays_overlap(telling, body)


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END))


def looks_like_navigation(title: Column, text: Column) -> Column:
    blocks = blocks_of(text)
    n = F.size(blocks)
    short = count_where(blocks, lambda b: F.length(b) < 80)
    long = count_where(blocks, lambda b: F.length(b) >= 200)
    dated = count_where(blocks, lambda b: has(b, LISTING_DATE_CUES))
    menus = count_where(blocks, lambda b: has(b, NAVIGATION_CUES))
    off_topic = (F.size(title_tokens(title)) == 0) | ~title_matches_body(title, text)
    return (
        ((menus >= 2) & off_topic)
        | ((n >= 20) & (long == 0))
        | ((n >= 8) & (dated >= 3) & (long <= 2))
        | ((n >= 6) & (short / n >= 0.75) & (sentence_count(text) < MIN_SENTENCES))
    )


def page_gate(title: Column, text: Column, signal: Column, url: Column) -> Column:
    """(status, reason) of an extracted page: the first rule that applies."""
    def result(status: str, reason: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))

    size = F.length(text)
    probe = F.concat(title, F.lit("\n"), text, F.when(size == 0, F.concat(F.lit("\n"), signal)).otherwise(""))
    gated = size < MAX_GATE_CHARS
    solid = count_where(F.split(text, "\n\n"), lambda b: F.length(b) >= 40)
    thin = "insufficient_text"
    whole = F.concat(title, F.lit("\n"), text)
    return (
        F.when(gated & has(probe, PAYWALL_CUES), result("paywall", "paywall-cue"))
        .when(gated & has(probe, BLOCKED_CUES), result("blocked", "blocked-page-cue"))
        .when(gated & has(probe, ERROR_PAGE_CUES), result(thin, "error-page-cue"))
        .when(size == 0, result(thin, "no-extracted-content"))
        .when(size < MIN_ARTICLE_CHARS, result(thin, f"less-than-{MIN_ARTICLE_CHARS}-characters"))
        .when(~title_matches_body(title, text), result(thin, "title-body-mismatch"))
        .when(looks_like_navigation(title, text), result(thin, "navigation-only"))
        .when((solid < MIN_ARTICLE_BLOCKS) & (sentence_count(text) < MIN_SENTENCES),
              result(thin, "insufficient-article-structure"))
        .when((size < 800) & (hits(text, PROMOTIONAL_CUES) >= 2), result(thin, "boilerplate-only"))
        .when(has(text, PRESS_RELEASE_CUES) | F.coalesce(has(url, PRESS_RELEASE_URL), F.lit(False)),
              result("extracted", "press-release"))
        .when(hits(whole, PROMOTION_CUES) >= 2, result("extracted", "promotional-content"))
        .otherwise(result("extracted", None))
    )


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def spaced(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tidy_block(block: Column) -> Column:
    """One block without edge pipes. The edges are stripped as a character set, which is
    linear where a nested pattern would backtrack."""
    spread = F.replace(block, F.lit("\\|"), F.lit(" | "))
    return squeezed(F.btrim(spread, F.lit("| \t\n\r\u000b\f")))


def with_clean_text(rows: DataFrame, text: str, title: str, out: str) -> DataFrame:
    """Add ``out``: the text's blocks without edge pipes, standalone noise and repeats, up to
    the first trailing section, and without a repeated title at the top.

    Each step is a column of its own, so no step is computed again inside the next."""
    tidied = F.transform(F.split(F.col(text), r"\r?\n"), tidy_block)
    cut = F.transform("_tidied", lambda b: F.struct(
        has(b, SECTION_CUES).alias("ends"),
        F.trim(F.split(b, f"(?i){SECTION_CUES}", 2)[0]).alias("block")))
    last = F.array_position(F.transform("_cut", lambda c: c["ends"]), F.lit(True))
    # The block holding the first section cue keeps what precedes the cue.
    kept = F.when(F.col("_last") > 0, F.slice("_cut", F.lit(1), F.col("_last").cast("int"))).otherwise(
        F.col("_cut"))
    texts = F.filter(F.transform(kept, lambda c: c["block"]),
                     lambda b: (b != "") & ~has(b, STANDALONE_NOISE))
    # Repeats ignoring case: neighbours after sorting by lower-case text, then position.
    ordered = F.array_sort(F.transform("_texts", lambda t, i: F.struct(
        F.lower(t).alias("k"), i.alias("i"), t.alias("t"))))
    firsts = F.filter("_ordered", lambda x, i: (i == 0) | (
        x["k"] != F.get(F.col("_ordered"), i - 1)["k"]))
    blocks = F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"], x["t"]))),
                         lambda x: x["t"])
    at = F.array_position(F.transform(
        F.col("_blocks"), lambda b: compact(b).startswith(F.col("_anchor"))), F.lit(True))
    from_title = F.when(
        (F.size("_blocks") >= 2) & (F.length("_anchor") >= 30) & (F.col("_at") > 0),
        F.slice("_blocks", F.col("_at").cast("int"), F.size("_blocks"))).otherwise(F.col("_blocks"))
    same_title = (F.col(title) != "") & (
        F.lower(F.get("_topped", 0)) == F.lower(F.col(title)))
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    untitled = F.when(same_title, rest("_topped")).otherwise(F.col("_topped"))
    first, opening = F.get("_untitled", 0), spaced(F.get("_untitled", 1))
    wrapper = compact(first).startswith(compact(F.col(title))) & (
        ((F.length(first) <= 500) & has(first, ARTICLE_METADATA_CUES))
        | ((F.length(opening) >= 80) & F.contains(spaced(first), opening)))
    final = F.when((F.size("_untitled") >= 2) & (F.col(title) != "") & wrapper,
                   rest("_untitled")).otherwise(F.col("_untitled"))
    steps = {
        "_tidied": tidied, "_cut": cut, "_last": last, "_texts": texts, "_ordered": ordered,
        "_blocks": blocks, "_anchor": compact(F.col(title)), "_at": at,
        "_topped": from_title, "_untitled": untitled,
    }
    for name, step in steps.items():
        rows = rows.withColumn(name, step)
    return rows.withColumn(out, F.array_join(final, "\n\n")).drop(*steps)


def published_date(value: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(value), 1, 10), "yyyy-MM-dd")


def validated_date(published: Column, event_day: Column, tolerance: int = 30) -> tuple[Column, Column]:
    """The date to keep and, when dropped, why; without an event day it stands."""
    outside = F.abs(F.datediff(published, event_day)) > tolerance
    drop = F.coalesce(outside, F.lit(False))
    return F.when(~drop, published), F.when(drop, F.lit("outside_event_window"))
