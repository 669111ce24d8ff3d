"""Actor-name tokens: how rare each is and which events they hit.

A token counts for an event when it is a substring of either actor name. Names repeat
endlessly, so the substring test runs once per distinct name: every substring of a name is
listed and joined to the token list on equality, which finds exactly the matches without
comparing each name with each token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.codes import ACTOR_MAX_SHARE, ACTOR_PROBES, STOP_ACTORS
from antecede.operators.heavyjoin import heavy_join

MIN_TOKEN = 3


def name_tokens(*names: Column) -> Column:
    """Distinct upper-case alphanumeric tokens of the names, without stop words."""
    words = F.split(F.upper(F.translate(F.concat_ws(" ", *names), ",", " ")), r"\s+")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(
        clean, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(*STOP_ACTORS)))


def name_matches(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """(name, matched tokens) for distinct ``names``(name) and ``tokens``(token)."""
    upper = F.upper("name")
    starts = names.select(
        "name", upper.alias("u"), F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"))
    room = F.length("u") - F.col("i") + 1
    pieces = starts.filter(room >= MIN_TOKEN).select(
        "name", "u", "i", F.explode(F.sequence(F.lit(MIN_TOKEN), room)).alias("size")
    ).select("name", F.substring(F.col("u"), F.col("i"), F.col("size")).alias("token")).distinct()
    return pieces.join(tokens, "token").groupBy("name").agg(F.collect_set("token").alias("matched"))


def actor_pairs(events: DataFrame) -> DataFrame:
    """Distinct actor-name pairs with their event counts."""
    return events.groupBy("Actor1Name", "Actor2Name").agg(F.count("*").alias("n"))


def distinct_names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("Actor1Name", "Actor2Name")).alias("name")).filter(
        "name <> ''").distinct()


def name_counts(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.groupBy(side).agg(F.sum("n").alias("n"))


def with_matches(rows: DataFrame, matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``matched``: the tokens found in either actor name. ``pairs`` says which names are common, so that rows of
    one name are split over tasks."""
    first = matches.select(F.col("name").alias("Actor1Name"), F.col("matched").alias("m1"))
    second = matches.select(F.col("name").alias("Actor2Name"), F.col("matched").alias("m2"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("m1", none), F.coalesce("m2", none))
    named = heavy_join(rows, first, ["Actor1Name"], "left", name_counts(pairs, "Actor1Name"))
    named = heavy_join(named, second, ["Actor2Name"], "left", name_counts(pairs, "Actor2Name"))
    return named.withColumn("matched", both).drop("m1", "m2")


def token_stats(pairs: DataFrame, matches: DataFrame, tokens: DataFrame) -> DataFrame:
    """df, share and idf of every token; a token found nowhere has df 0."""
    total = pairs.agg(F.sum("n")).scalar()
    found = with_matches(pairs, matches, pairs).select(F.explode("matched").alias("token"), "n").groupBy(
        "token").agg(F.sum("n").alias("df"))
    return tokens.join(found, "token", "left").select(
        "token", F.coalesce("df", F.lit(0)).alias("df")
    ).withColumns({
        "share": F.col("df") / total, "idf": F.log(total / (1 + F.col("df"))),
    })


def usable(stats: DataFrame, max_share: float = ACTOR_MAX_SHARE) -> DataFrame:
    return stats.filter((F.col("df") > 0) & (F.col("share") <= max_share))


def pair_probes(pairs: DataFrame, stats: DataFrame, keep: int = ACTOR_PROBES) -> DataFrame:
    """Per actor pair, its rarest usable tokens with their weights (idf share)."""
    listed = pairs.select("Actor1Name", "Actor2Name", F.explode(
        name_tokens(F.col("Actor1Name"), F.col("Actor2Name"))).alias("token"))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct(
        (-F.col("idf")).alias("rank"), "token"))), 1, keep)
    chosen = listed.join(usable(stats).select("token", "idf"), "token").groupBy(
        "Actor1Name", "Actor2Name").agg(rarest.alias("probes"))
    total = F.aggregate("probes", F.lit(0.0), lambda acc, p: acc - p["rank"])
    safe_total = F.when(total == 0, 1.0).otherwise(total)
    return chosen.select(
        "Actor1Name", "Actor2Name",
        F.transform("probes", lambda p: F.struct(
            p["token"].alias("token"), (-p["rank"] / safe_total).alias("weight"))).alias("probes"),
    )
