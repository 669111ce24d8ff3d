"""Channel scores, fusion, grades and their wording, as column expressions."""

from __future__ import annotations

from math import log1p

from pyspark.sql import Column, functions as F

from antecede.functions.codes import (
    CHANNEL_WEIGHTS, CONFIDENCE_FLOOR, FULL_OUTLETS, INTERCEPT, ROOT_LABEL, lookup,
)
from antecede.functions.rounding import steady_round


def one() -> Column:
    return F.lit(1.0)


def zero() -> Column:
    return F.lit(0.0)


def corroboration(domains: Column) -> Column:
    """Log scale: FULL_OUTLETS distinct outlets is full marks."""
    return F.least(F.log1p(domains) / F.lit(log1p(FULL_OUTLETS)), one())


def prior(lift: Column) -> Column:
    """Lift 1 is no pattern, 8 is a full one."""
    return F.least(F.greatest((F.coalesce(lift, zero()) - 1.0) / 7.0, zero()), one())


def contrastive(sufficiency: Column, necessity: Column) -> Column:
    suff, nec = F.coalesce(sufficiency, zero()), F.coalesce(necessity, zero())
    return F.least(0.75 * F.greatest(suff, zero()) + 0.25 * nec, one())


def logistic(z: Column) -> Column:
    return F.when(z < -60, 0.0).when(z > 60, 1.0).otherwise(1.0 / (1.0 + F.exp(-z)))


def fused(channels: dict[str, Column]) -> Column:
    """Weighted sum of the channels; one with no evidence adds nothing."""
    total = F.lit(INTERCEPT)
    for name, weight in CHANNEL_WEIGHTS.items():
        if name in channels:
            total = total + F.lit(weight) * channels[name]
    return total


def terms(channels: dict[str, Column]) -> Column:
    """Per-channel weight and contribution, to re-derive the sum by hand."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("key"), F.lit(weight).alias("weight"),
            steady_round(F.lit(weight) * channels.get(name, zero()), 3).alias("contribution"),
            F.lit(name in channels).alias("available"),
        )
        for name, weight in CHANNEL_WEIGHTS.items()
    ])


def strength_word(score: Column, available: bool = True) -> Column:
    if not available:
        return F.lit("unavailable")
    return (
        F.when(score >= 0.70, "strong").when(score >= 0.40, "moderate")
        .when(score >= 0.15, "weak").when(score > 0, "very weak").otherwise("none")
    )


def grade(documented: Column, corroborated: Column, prior_: Column, contrast: Column,
          actors: Column, sufficiency: Column, confidence: Column) -> Column:
    pattern = (prior_ + contrast + actors) / 3.0
    return (
        F.when((documented >= 0.5) & (corroborated >= 0.5), "confirmed")
        .when(documented >= 0.5, "reported")
        .when((pattern >= 0.45) & (F.coalesce(sufficiency, zero()) >= 0.30), "pattern")
        .when(confidence >= CONFIDENCE_FLOOR, "weak")
        .otherwise("dropped")
    )


def trace() -> Column:
    """The derivation of each available channel in words, over a scored candidate row."""
    cause = lookup(ROOT_LABEL, F.col("root_code"), F.col("root_code"))
    effect = lookup(ROOT_LABEL, F.col("target_root"), F.col("target_root"))
    linked = F.col("documented") >= 0.5

    def entry(key: str, plain: Column, math: Column) -> Column:
        return F.struct(
            F.lit(key).alias("key"), F.col(key).alias("score"),
            strength_word(F.col(key)).alias("strength"),
            plain.alias("plain"), math.alias("math"),
        )

    return F.array(
        entry(
            "documented",
            F.when(linked, "A recorded precursor link joins this group to the target.")
            .otherwise("No recorded link joins this group to the target."),
            F.format_string("precursor group (%s, %s)", F.col("cause_day"), F.col("root_code")),
        ),
        entry(
            "corroboration",
            F.format_string("%d outlets carried events of this group.", F.col("domains")),
            F.format_string("log1p(%d) / log1p(40)", F.col("domains")),
        ),
        entry(
            "prior",
            F.format_string("A busy %s day makes a busy %s day %.1f times as likely.",
                            cause, effect, F.coalesce("lift", zero())),
            F.format_string("(lift %.3f - 1) / 7", F.coalesce("lift", zero())),
        ),
        entry(
            "contrastive",
            F.format_string("%.0f%% of busy %s days led to a busy %s day; %.0f%% of those had one before.",
                            100 * F.coalesce("sufficiency", zero()), cause, effect,
                            100 * F.coalesce("necessity", zero())),
            F.format_string("0.75 x %.3f + 0.25 x %.3f", F.coalesce("sufficiency", zero()),
                            F.coalesce("necessity", zero())),
        ),
        entry(
            "actors",
            F.format_string("Distinctive names of the target weigh %.3f in this group.",
                            F.col("actors")),
            F.format_string("sum of hits / %d x idf share", F.col("event_count")),
        ),
    )


def top_reasons(trace_column: Column, keep: int = 3) -> Column:
    """The strongest channels of a trace, joined into one line."""
    ranked = F.array_sort(
        trace_column,
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .otherwise(F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)),
    )
    lines = F.transform(
        F.slice(ranked, 1, keep),
        lambda w: F.format_string("%s=%.2f: %s", w["key"], w["score"], w["plain"]),
    )
    return F.array_join(lines, " | ")
