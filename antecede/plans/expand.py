"""Level-by-level expansion: the best candidates of one level are the next level's targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from antecede.plans.score_causes import listed_candidates, score_targets
from antecede.session import checkpointed


def expand(events: DataFrame, seeds: DataFrame, depth: int = 3, follow: int = 5,
           listed: int = 14) -> DataFrame:
    """Scored candidates of every target reached, tagged with the level that reached it.

    A level is one batch job over all its targets; a target is scored once, at its first
    level. Targets without a candidate appear with an empty group: a branching of zero."""
    levels = []
    frontier = seeds.select("GlobalEventID")
    done = frontier.limit(0)
    for level in range(1, depth + 1):
        fresh = checkpointed(frontier.join(done, "GlobalEventID", "left_anti").distinct())
        done = done.unionByName(fresh)
        targets = events.join(fresh, "GlobalEventID", "left_semi")
        scored = checkpointed(listed_candidates(score_targets(events, targets), listed))
        rows = fresh.withColumnRenamed("GlobalEventID", "target_id").join(scored, "target_id", "left").select(
            F.lit(level).alias("depth"), "target_id",
            F.concat_ws("-", F.col("cause_day").cast("string"), "root_code").alias("cand_group_id"),
            "rep_id", "event_count", "confidence", "grade", "rank")
        levels.append(checkpointed(rows))
        frontier = scored.filter(F.col("rank") <= follow).select(F.col("rep_id").alias("GlobalEventID")).distinct()
    return reduce(DataFrame.unionByName, levels)
