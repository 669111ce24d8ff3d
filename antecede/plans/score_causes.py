"""Score candidate causes of many target events in one job.

A candidate is a (country, day, code) group in the window before the target. Targets meet
groups on (country, day); group statistics, token hits and the type-pair matrix are all far
smaller than the event table. Evidence from the three sources is brought together by one
grouped aggregation on (window, day, code) instead of three joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions import scores as S
from antecede.functions.codes import (
    KEPT_GRADES, MIN_GROUP_EVENTS, WINDOW_DAYS, padded_root,
)
from antecede.functions.dates import day_of_date
from antecede.functions.rounding import steady_round
from antecede.operators import actors as A
from antecede.operators.heavyjoin import heavy_join
from antecede.operators.typepairs import type_pair_matrix
from antecede.session import checkpointed

PLACE, ROOT, DATE = "ActionGeo_CountryCode", "EventRootCode", "event_date"


def candidate_groups(events: DataFrame) -> DataFrame:
    """One row per (country, day, code): size, distinct outlets, mean tone, smallest id."""
    outlet = F.regexp_extract("SOURCEURL", "://([^/]+)", 1)
    # Outlets are made distinct by a first aggregation, so no group holds them all at once.
    key = [F.col(PLACE).alias("cc"), F.col(DATE).alias("c_date"), padded_root(F.col(ROOT)).alias("c_rc")]
    by_outlet = events.groupBy(*key, outlet.alias("outlet")).agg(
        F.count("*").alias("k"), F.sum("GoldsteinScale").alias("g"),
        F.count("GoldsteinScale").alias("g_n"), F.min("GlobalEventID").alias("rep"))
    return by_outlet.groupBy("cc", "c_date", "c_rc").agg(
        F.sum("k").alias("event_count"), F.count("outlet").alias("domains"),
        (F.sum("g") / F.sum("g_n")).alias("avg_goldstein"), F.min("rep").alias("rep_id"))


def group_hits(events: DataFrame, matches: DataFrame, tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many events of each group name each of the ``tokens``."""
    counts = events.groupBy(
        F.col(PLACE).alias("cc"), F.col(DATE).alias("c_date"), padded_root(F.col(ROOT)).alias("c_rc"),
        "Actor1Name", "Actor2Name").agg(F.count("*").alias("k"))
    return A.with_matches(counts, matches, pairs).select(
        "cc", "c_date", "c_rc", F.explode("matched").alias("token"), "k"
    ).groupBy("cc", "c_date", "c_rc", "token").agg(F.sum("k").alias("hits")).join(tokens, "token")


def token_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Token statistics, tokens matched per name, probes per actor pair, and the pairs with their counts."""
    pairs = checkpointed(A.actor_pairs(events))
    names = A.distinct_names(pairs)
    tokens = names.select(F.explode(A.name_tokens(F.col("name"))).alias("token")).distinct()
    matches = checkpointed(A.name_matches(names, tokens))
    stats = A.token_stats(pairs, matches, tokens)
    return stats, matches, A.pair_probes(pairs, stats), pairs


def documented_groups(targets: DataFrame, events: DataFrame) -> DataFrame:
    """(target, day, code) of the target's precursors, looked up in ``events``."""
    listed = targets.select(
        F.col("GlobalEventID").alias("target_id"),
        F.explode("precursors").alias("GlobalEventID"))
    found = events.select("GlobalEventID", F.col(DATE).alias("c_date"),
                          padded_root(F.col(ROOT)).alias("c_rc"))
    return listed.join(found, "GlobalEventID").select("target_id", "c_date", "c_rc").distinct()


def target_windows(targets: DataFrame, arm: str = "real", first: Column | None = None,
                   last: Column | None = None) -> DataFrame:
    """Windows to score: by default the 7 days before each target."""
    day = F.col(DATE)
    return targets.select(
        F.col("GlobalEventID").alias("target_id"), F.lit(arm).alias("arm"),
        F.col(PLACE).alias("cc"), day.alias("t_date"),
        padded_root(F.col(ROOT)).alias("target_root"), "Actor1Name", "Actor2Name",
        (F.date_sub(day, WINDOW_DAYS) if first is None else first).alias("first_date"),
        (F.date_sub(day, 1) if last is None else last).alias("last_date"),
    )


def score_windows(events: DataFrame, windows: DataFrame, documented: DataFrame) -> DataFrame:
    """Every scored candidate group of every window.

    ``documented`` is keyed by (target_id, arm, c_date, c_rc). ``events`` is read several
    times, so pass a stored table rather than a long plan."""
    key = ["target_id", "arm", "cc", "target_root", "t_date", "c_date", "c_rc"]
    token_table, matches, probes, pairs = token_tables(events)
    usable = A.usable(token_table).select("token")
    groups = candidate_groups(events).filter(F.col("event_count") >= MIN_GROUP_EVENTS)
    stats = ["event_count", "domains", "avg_goldstein", "rep_id"]

    days = windows.withColumn("c_date", F.explode(F.sequence("first_date", "last_date")))
    found = days.join(groups, ["cc", "c_date"]).select(
        *key, *stats, F.lit(0.0).alias("hit"), F.lit(0.0).alias("doc"))

    probed = heavy_join(windows, probes, ["Actor1Name", "Actor2Name"], counts=pairs).select(
        "target_id", "arm", "cc", "target_root", "t_date", "first_date", "last_date",
        F.explode("probes").alias("p"),
    ).withColumn("c_date", F.explode(F.sequence("first_date", "last_date"))).withColumns(
        {"token": F.col("p.token"), "weight": F.col("p.weight")})
    null = lambda name: F.lit(None).cast(groups.schema[name].dataType).alias(name)
    hits = probed.join(group_hits(events, matches, usable, pairs), ["cc", "c_date", "token"]).select(
        *key, *[null(s) for s in stats], (F.col("weight") * F.col("hits")).alias("hit"),
        F.lit(0.0).alias("doc"))
    linked = windows.join(documented, ["target_id", "arm"]).filter(
        F.col("c_date").between(F.col("first_date"), F.col("last_date"))
    ).select(*key, *[null(s) for s in stats], F.lit(0.0).alias("hit"), F.lit(1.0).alias("doc"))

    merged = found.unionByName(hits).unionByName(linked).groupBy(*key).agg(
        *[F.max(s).alias(s) for s in stats], F.sum("hit").alias("hit"), F.max("doc").alias("documented"),
    ).filter(F.col("event_count").isNotNull())
    matrix = type_pair_matrix(events).select(
        "cc", F.col("crc").alias("c_rc"), F.col("erc").alias("target_root"),
        "sufficiency", "necessity", "lift")
    return with_scores(merged.join(matrix, ["cc", "c_rc", "target_root"], "left"))


def with_scores(rows: DataFrame) -> DataFrame:
    raw = {
        "documented": F.col("documented"),
        "corroboration": S.corroboration(F.col("domains")),
        "prior": S.prior(F.col("lift")),
        "contrastive": S.contrastive(F.col("sufficiency"), F.col("necessity")),
        "actors": F.least(F.col("hit") / F.col("event_count"), S.one()),
    }
    shown = {name: steady_round(value, 3) for name, value in raw.items()}
    z = S.fused(shown)
    confidence = S.logistic(z)
    graded = S.grade(
        raw["documented"], raw["corroboration"], raw["prior"], raw["contrastive"],
        raw["actors"], F.col("sufficiency"), confidence)
    return rows.select(
        "target_id", "arm", "cc", "target_root", F.col("c_rc").alias("root_code"),
        day_of_date(F.col("t_date")).alias("target_day"),
        day_of_date(F.col("c_date")).alias("cause_day"),
        F.greatest(F.datediff("t_date", "c_date"), F.lit(0)).alias("lag_days"),
        "event_count", "domains", "avg_goldstein", "rep_id", "sufficiency", "necessity", "lift",
        *[value.alias(name) for name, value in shown.items()],
        F.lit(False).alias("contradiction_available"),
        steady_round(z, 3).alias("z"), steady_round(confidence, 4).alias("confidence"),
        graded.alias("grade"), (F.col("c_rc") == F.col("target_root")).alias("self_pair"),
    )


def best_per_type(scored: DataFrame) -> DataFrame:
    """One candidate per target, arm and event type: most confident, then nearest, then
    earliest day. ``min`` of a struct combines map-side."""
    order = F.struct((-F.col("confidence")).alias("k"), "lag_days", "cause_day")
    rest = [c for c in scored.columns if c not in ("target_id", "arm", "root_code")]
    best = F.min(F.struct(order.alias("order"), F.struct(*rest).alias("row"))).alias("best")
    return scored.groupBy("target_id", "arm", "root_code").agg(best).select(
        "target_id", "arm", "root_code", "best.row.*")


def score_targets(events: DataFrame, targets: DataFrame) -> DataFrame:
    """The best scored candidate per target and event type."""
    documented = documented_groups(targets, events).withColumn("arm", F.lit("real"))
    return best_per_type(score_windows(events, target_windows(targets), documented))


def listed_candidates(best: DataFrame, keep: int = 14) -> DataFrame:
    ranked = Window.partitionBy("target_id").orderBy(F.desc("confidence"), "lag_days", "root_code")
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= keep)


def target_summary(best: DataFrame) -> DataFrame:
    """Grade counts per target and the share of confidence in grades worth standing behind."""
    kept = F.col("grade").isin(*KEPT_GRADES)
    grades = ("confirmed", "reported", "pattern", "weak", "dropped")
    return best.groupBy("target_id").agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col("grade") == g).alias(g) for g in grades],
        steady_round(
            F.sum(F.when(kept, F.col("confidence")).otherwise(0.0)) / F.sum("confidence"), 3
        ).alias("coverage"),
    )
