"""Benchmark decontamination by template windows with consistent slots.

Numbers, names and units become typed placeholders, so a question whose values were swapped has the
same template as the original. Template windows of documents meet the windows of benchmark items in
a hash join; windows on one diagonal (document position minus item position) form a match, which
counts when it covers enough of the item and every item value maps to one document value.

A capital within a sentence marks a name. Where neighbours are capitalised too (shouted text, titles) that tells nothing, so such
documents give a second sequence of windows, without names, which meets the items' windows without names. Values of
names are compared either way.

Only column expressions. The benchmark side is broadcast when its counted windows stay below
``BROADCAST_WINDOWS``; beyond it, both sides are shuffled by window hash. Documents are exploded
into window hashes without their text, and only rows that hit the benchmark travel.

Defined results: a null or empty text matches nothing; an item without a window of at least
``MIN_LITERALS`` different plain words cannot be matched; items of equal text count as their smallest
id; a text met by no item is clean; rows that repeat both id and text share their verdict; a null
id is a key of its own. Extra columns pass through ``clean``. An empty benchmark leaves all clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import free_names, joined_small, stored

WINDOW = 8
BROADCAST_KEYS = 500_000  # row keys that may be broadcast
MIN_COVERED = 13  # tokens of an item that a match covers, or the whole item where it is shorter
MIN_LITERALS = 4
BROADCAST_WINDOWS = 1_000_000
UNITS = (
    "%", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards",
    "mile", "miles", "metre", "metres", "meter", "meters", "mg", "g", "kg", "gram", "grams", "ton",
    "tons", "lb", "lbs", "pound", "pounds", "oz", "ml", "l", "litre", "litres", "liter", "liters",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent",
    "cents", "percent", "degree", "degrees", "kmh", "mph",
)
SPACE = r"\x20\x09-\x0D"
START = "\u0001"  # marks a capital that only opens a sentence


def _marked(text: Column) -> Column:
    """Text without punctuation, with sentence-opening capitals marked."""
    opened = F.regexp_replace(text, rf"(^|[.!?:][\"')]*[{SPACE}]+|\n[{SPACE}]*)(\p{{Lu}})", f"$1{START}$2")
    plain = F.regexp_replace(opened, rf"[^\p{{L}}\p{{N}}{SPACE}.,%{START}]+", "")
    return F.regexp_replace(plain, rf"[.,]+([{SPACE}]|\z)", "$1")


def _split(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), START, ""), f"[{SPACE}]+"), lambda w: w != "")


def with_tokens(df: DataFrame) -> DataFrame:
    """Add ``template`` and ``values``: tokens with and without placeholders, position by position; and ``plain``, the template
    without names, and whether the text is ``shouted``: whether names stand side by side."""
    marked = df.withColumn("_marked", _marked(F.coalesce("text", F.lit(""))))
    named = F.regexp_replace("_marked", rf"([{SPACE}])\p{{Lu}}[^{SPACE}]*", "$1<name>")

    def typed(text: Column) -> Column:
        numbered = F.regexp_replace(text, r"[0-9][0-9.,]*", "<num>")
        return F.transform(_split(numbered), lambda w: F.when(w.isin(*UNITS), "<unit>").otherwise(w))

    return marked.withColumns({
        "template": typed(named), "values": _split(F.col("_marked")), "plain": typed(F.col("_marked")),
        "shouted": F.col("_marked").rlike(rf"[{SPACE}]\p{{Lu}}[^{SPACE}]*[{SPACE}]+\p{{Lu}}"),
    }).drop("_marked")


def _windows(width: int, tokens: str = "template") -> Column:
    """Hashes of the template windows of one width, by position."""
    return F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - width + 1, F.lit(0))),
                       lambda _, i: F.xxhash64(F.lit(width), F.slice(tokens, i + 1, width)))


def _literals(width: int, tokens: str) -> Column:
    return F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - width + 1, F.lit(0))),
                       lambda _, i: F.size(F.array_distinct(F.filter(
                           F.slice(tokens, i + 1, width), lambda w: ~w.startswith("<")))))


def _covered(at: Column, width: Column) -> Column:
    """Tokens covered by windows that start at the ordered positions ``at``."""
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("last")), lambda acc, p: F.struct(
        (acc["n"] + F.least(width, p - acc["last"])).alias("n"), p.alias("last")))["n"]


def row_key() -> tuple[Column, Column]:
    """Id (null-safe) and hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """Add the row key as ``_id`` and ``_th``."""
    return docs.withColumns(dict(zip(("_id", "_th"), row_key())))


def _items(benchmark: DataFrame) -> DataFrame:
    """Distinct items with their tokens and the width of their windows."""
    one = benchmark.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    return with_tokens(one).filter(F.size("template") > 0).select(
        "item_id", "template", "values", "plain", F.least(F.lit(WINDOW), F.size("template")).alias("width"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matches (_id, _th, item_id, diagonal, covered, consistent, reparameterised) that cover enough of an item."""
    items = stored(_items(benchmark), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most WINDOW values
    hits = None
    if not widths:
        widths = [WINDOW]
    wanted = None
    for w in widths:
        for tokens in ("template", "plain"):
            part = items.filter(F.col("width") == w).select("item_id", F.posexplode_outer(F.arrays_zip(
                _windows(w, tokens).alias("h"), _literals(w, tokens).alias("n"))).alias("item_at", "x")).filter(
                F.col("x.n") >= F.least(F.lit(MIN_LITERALS), F.lit(w))).select("item_id", "item_at", F.col("x.h").alias("h"))
            wanted = part if wanted is None else wanted.unionByName(part)
    wanted = stored(wanted.distinct(), "item_windows")
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    seen = with_tokens(keyed(docs.select("doc_id", "text"))).select(
        "_id", "_th", *[_windows(w).alias(f"w{w}") for w in widths],
        *[F.when(F.col("shouted"), _windows(w, "plain")).alias(f"p{w}") for w in widths])
    for w in [f"{kind}{w}" for w in widths for kind in "wp"]:  # the outer form keeps Spark from filtering on the array's size, which repeats its expression
        part = seen.select("_id", "_th", F.posexplode_outer(w).alias("doc_at", "h")).join(wanted, "h").select(
            "_id", "_th", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), "item_at")
        hits = part if hits is None else hits.unionByName(part)
    # A diagonal holds at most the windows of its item.
    runs = stored(hits.groupBy("_id", "_th", "item_id", "diagonal").agg(
        F.array_sort(F.collect_set("item_at")).alias("at")), "runs")
    sized = runs.join(items, "item_id").withColumn("covered", _covered(F.col("at"), F.col("width"))).filter(
        F.col("covered") >= F.least(F.lit(MIN_COVERED), F.size("template")))
    met = runs.select("_id", "_th").distinct()
    texts = joined_small(keyed(docs.select("doc_id", "text")), met, ["_id", "_th"], limit=BROADCAST_KEYS).dropDuplicates(["_id", "_th"])
    valued = with_tokens(texts).select("_id", "_th", F.col("values").alias("doc_values"))
    slots = F.array_distinct(F.filter(F.flatten(F.transform("at", lambda a: F.transform(
        F.sequence(F.lit(0), F.col("width") - 1), lambda o: F.struct(
            F.get("template", a + o).alias("kind"), F.get("values", a + o).alias("ours"),
            F.get("doc_values", a + o + F.col("diagonal")).alias("theirs"))))),
        lambda s: s["kind"].rlike("<(name|num|unit)>")))
    return sized.join(valued, ["_id", "_th"]).withColumn("slots", slots).select(
        "_id", "_th", "item_id", "diagonal", "covered",
        (F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["ours"])))) == F.size("slots")).alias("consistent"),
        F.exists("slots", lambda s: ~s["ours"].eqNullSafe(s["theirs"])).alias("reparameterised"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated text: the item covered most, and whether values were swapped."""
    return matches(docs, benchmark).filter("consistent").groupBy("_id", "_th").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.max(F.struct("covered", (-F.col("item_id")).alias("order"), "item_id")).alias("best"),
        F.min("reparameterised").alias("reparameterised")
    ).select("_id", "_th", "n_items", F.col("best.item_id").alias("item_id"), F.col("best.covered").alias("covered"),
             "reparameterised")


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, covered, reparameterised for every document."""
    found = verdicts(docs, benchmark)
    return keyed(docs.select("doc_id", "text")).select("doc_id", "_id", "_th").join(found, ["_id", "_th"], "left").select(
        "doc_id", F.col("item_id").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id",
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = stored(verdicts(docs, benchmark).select("_id", "_th"), "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    id_, th = free_names(docs, "_id", "_th")
    return docs.withColumns(dict(zip((id_, th), row_key()))).join(found.toDF(id_, th), [id_, th], "left_anti").drop(id_, th)
