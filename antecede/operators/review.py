"""Claims, reviewers and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.codes import EVIDENCE_QUALITIES, REJECT_REASONS, RELATIONS
from antecede.functions.rounding import steady_round
from antecede.operators.ordering import with_position, with_running_total
from antecede.session import checkpointed

# Fixed values of the branching projection.
PROJECTION_SEEDS = 500
GATE_BRANCHING = 4.0


def with_flag(rows: DataFrame, present: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean telling whether the key occurs in ``present``."""
    found = present.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(found, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def deal(claims: DataFrame, annotators: Sequence[str], every: int = 4) -> DataFrame:
    """Deal claims round-robin in claim order; one block in ``every`` gets a second reader.

    Blocks, not single claims, are chosen, so every person's pile holds second readings."""
    names, k = F.array(*[F.lit(a) for a in annotators]), len(annotators)
    n = F.col("position") - 1
    person = lambda i: F.get(names, (i % k).cast("int"))
    # Whole claims are not written to be numbered: their ids alone are.
    placed = claims.join(with_position(claims.select("claim_id"), [F.col("claim_id")]), "claim_id")
    return placed.withColumns({
        "primary_annotator": person(n),
        "review_annotator": F.when(F.floor(n / k) % every == 0, person(n + 1)),
    }).drop("position")


def assignments(dealt: DataFrame) -> DataFrame:
    """One row per (claim, person, role)."""
    role = lambda column, name: dealt.filter(F.col(column).isNotNull()).select(
        "claim_id", "effect_id", "machine_strength", F.col(column).alias("who"), F.lit(name).alias("role"))
    return role("primary_annotator", "primary").unionByName(role("review_annotator", "review"))


def reading_loads(assigned: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("role") == name)
    return assigned.groupBy("who").agg(
        count("primary").alias("primary_load"), count("review").alias("review_load"))


def unjudged(assigned: DataFrame, annotations: DataFrame) -> DataFrame:
    """Assignments without a judgement by that person; ``annotations`` has (claim_id, who)."""
    return assigned.join(annotations.select("claim_id", "who"), ["claim_id", "who"], "left_anti")


def progress(assigned: DataFrame, annotations: DataFrame) -> DataFrame:
    done = annotations.select("claim_id", "who").distinct().withColumn("judged", F.lit(True))
    rows = assigned.join(done, ["claim_id", "who"], "left").withColumn(
        "judged", F.coalesce("judged", F.lit(False)))
    # Targets are made distinct per person first, so one person's pile never sits in one task.
    targets = rows.groupBy("who", "effect_id").agg(
        F.count("*").alias("n"), F.count_if("judged").alias("done"))
    return targets.groupBy("who").agg(
        F.sum("n").alias("assigned"), F.sum("done").alias("judged"),
        F.count_if(F.col("done") < F.col("n")).alias("targets_left"))


def next_claims(open_claims: DataFrame) -> DataFrame:
    """Per person and target, the strongest open claim; claims without a strength come last."""
    best = F.min(F.struct(
        F.col("machine_strength").isNull().alias("unknown"),
        (-F.col("machine_strength")).alias("k"), "claim_id")).alias("b")
    return open_claims.groupBy("who", "effect_id").agg(best).select(
        "who", "effect_id", "b.claim_id", (-F.col("b.k")).alias("machine_strength"))


def with_endpoints(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Claims with both their events' fields."""
    side = lambda name: events.select(
        F.col("GlobalEventID").alias(f"{name}_id"), F.col("EventRootCode").alias(f"{name}_type"),
        F.col("day").alias(f"{name}_day"), F.col("Actor1Name").alias(f"{name}_actor"))
    return claims.select("claim_id", "cause_id", "effect_id").join(side("cause"), "cause_id").join(
        side("effect"), "effect_id")


def suggested_relation(cause_type: Column, effect_type: Column, lag_days: Column) -> Column:
    return (
        F.when((cause_type != "") & (cause_type == effect_type), "ESCALATES")
        .when(lag_days <= 3, "TRIGGERS").when(lag_days <= 21, "MOBILIZES")
        .otherwise("CONTRIBUTES_TO"))


def whole_group_sample(claims: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """Claims of whole groups, drawn in seeded hash order until they hold ``share`` of all."""
    groups = claims.groupBy(group).agg(F.count("*").alias("n"))
    order = F.sha2(F.concat(F.lit(seed), F.col(group).cast("string")), 256)
    run = checkpointed(with_running_total(groups, [order], F.col("n")))
    total = run.agg(F.sum("n")).scalar()
    picked = run.filter(F.col("before") < share * total).select(group)
    return claims.join(picked, group, "left_semi")


def sampled_targets(rows: DataFrame, per_depth: int, seed: str) -> DataFrame:
    """Whole targets per depth, never part of one; the limit is the sample size."""
    targets = rows.select("depth", "target_id").distinct()
    order = F.sha2(F.concat(F.lit(seed), F.col("target_id").cast("string")), 256)
    ranked = Window.partitionBy("depth").orderBy(order, "target_id")
    chosen = targets.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= per_depth)
    return rows.join(chosen.select("target_id").distinct(), "target_id", "left_semi")


def label_pairs(primary: DataFrame, second: DataFrame) -> DataFrame:
    """Counts of (field, a, b) over claims both judged: the decision on all of them, the
    relation where both accepted, the reason where both rejected. The counts are tiny, and
    every agreement figure below reads only them."""
    names = ["decision", "relation", "reject_reason"]
    side = lambda df, p: df.select("claim_id", *[F.col(n).alias(p + n) for n in names])
    both = side(primary, "a_").join(side(second, "b_"), "claim_id")
    agreed = lambda what: (F.col("a_decision") == what) & (F.col("b_decision") == what)
    row = lambda n: F.struct(F.lit(n).alias("field"), F.col(f"a_{n}").alias("a"), F.col(f"b_{n}").alias("b"))
    listed = F.array_compact(F.array(
        row("decision"), F.when(agreed("accept"), row("relation")),
        F.when(agreed("reject"), row("reject_reason"))))
    return both.select(F.inline(listed)).groupBy("field", "a", "b").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Observed agreement and Cohen's kappa per field; kappa is null when chance is 1."""
    left = pairs.groupBy("field", F.col("a").alias("label")).agg(F.sum("n").alias("l"))
    right = pairs.groupBy("field", F.col("b").alias("label")).agg(F.sum("n").alias("r"))
    chance = left.join(right, ["field", "label"]).groupBy("field").agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    same = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))
    totals = pairs.groupBy("field").agg(F.sum("n").alias("pairs"), same.alias("same"))
    observed = F.col("same") / F.col("pairs")
    expected = F.coalesce("lr", F.lit(0)) / (F.col("pairs") * F.col("pairs"))
    return totals.join(chance, "field", "left").select(
        "field", "pairs", steady_round(observed, 4).alias("observed"),
        F.when(expected != 1, steady_round((observed - expected) / (1 - expected), 4)).alias("kappa"))


def specific_agreement(pairs: DataFrame, field: str = "relation") -> DataFrame:
    """Per label: of the times either reader chose it, how often both did."""
    rows = pairs.filter(F.col("field") == field).select(
        F.explode(F.array_distinct(F.array("a", "b"))).alias("label"), "a", "b", "n")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    is_a, is_b = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    return rows.groupBy("label").agg(
        total(is_a).alias("first"), total(is_b).alias("second"), total(is_a & is_b).alias("both"),
    ).withColumn("specific_agreement", steady_round(
        2 * F.col("both") / (F.col("first") + F.col("second")), 4))


def recall(edges: DataFrame, missed: DataFrame, tuning: DataFrame) -> DataFrame:
    """Accepted over accepted plus missed causes, for tuning and fresh targets."""
    hits = edges.groupBy("effect_id").agg(F.count_if(F.col("decision") == "accept").alias("accepted"))
    lost = missed.groupBy("effect_id").agg(F.count("*").alias("missed"))
    rows = tuning.join(hits, "effect_id", "left").join(lost, "effect_id", "left")
    return rows.groupBy("tuning").agg(
        F.count("*").alias("seeds"), F.sum(F.coalesce("accepted", F.lit(0))).alias("accepted"),
        F.sum(F.coalesce("missed", F.lit(0))).alias("missed"),
    ).withColumn("recall", steady_round(
        F.try_divide(F.col("accepted"), F.col("accepted") + F.col("missed")), 4))


def judgement_profile(judged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts of every value of several fields in one pass, as (field, value, n)."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                       for f in fields])
    return judged.select(F.inline(listed)).filter("value IS NOT NULL").groupBy("field", "value").agg(
        F.count("*").alias("n"))


def fill_rates(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of rows with each field filled: non-empty arrays or text, non-null otherwise."""
    def filled(name: str) -> Column:
        kind = rows.schema[name].dataType.typeName()
        if kind == "array":
            return F.size(name) > 0
        return F.col(name).isNotNull() & (F.col(name) != "") if kind == "string" else F.col(name).isNotNull()

    return rows.agg(*[steady_round(F.count_if(F.coalesce(filled(f), F.lit(False))) / F.count("*"), 4).alias(f)
                      for f in fields])


def missing_ids(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, each once: no rows means the two sets are equal. A null id equals none.

    Both sides are counted in one pass; an anti join each way would keep and sort the distinct ids of both in one task."""
    side = lambda df, own: df.select(key, F.lit(own).alias("ours"), F.lit(not own).alias("theirs"))
    seen = side(expected, True).unionByName(side(given, False)).groupBy(key).agg(
        F.bool_or("ours").alias("ours"), F.bool_or("theirs").alias("theirs"))
    alone = lambda own, other, name: F.when(F.col(own) & (~F.col(other) | F.col(key).isNull()), F.lit(name))
    return seen.filter(~F.col("ours") | ~F.col("theirs") | F.col(key).isNull()).select(key, F.explode(F.array_compact(F.array(
        alone("ours", "theirs", "missing"), alone("theirs", "ours", "unexpected")))).alias("problem"))


def branching(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted causes per completely judged target: per depth, and overall with the
    projection to three levels. A partly judged target would understate its count."""
    verdict = F.lower(F.trim(F.coalesce("accept", F.lit(""))))
    real = F.coalesce("cand_group_id", F.lit("")) != ""
    yes = real & (verdict == "y")
    targets = rows.groupBy("target_id", "depth").agg(
        F.every(verdict.isin("y", "n", "-")).alias("complete"),
        F.count_if(real).alias("retrieved"), F.count_if(yes).alias("accepted"),
        F.sum(F.when(yes, F.col("event_count"))).alias("events"))
    done = targets.filter("complete")
    by_depth = done.groupBy("depth").agg(
        F.count("*").alias("targets"), steady_round(F.avg("retrieved"), 2).alias("mean_retrieved"),
        steady_round(F.avg("accepted"), 2).alias("mean_accepted"),
        F.percentile("accepted", 0.5).alias("median_accepted"),
        F.min("accepted").alias("min_accepted"), F.max("accepted").alias("max_accepted"))
    total = done.agg(
        F.count("*").alias("targets_judged"),
        F.count_if(F.col("retrieved") > 0).alias("targets_with_candidates"),
        F.avg("accepted").alias("b"), F.coalesce(F.stddev_samp("accepted"), F.lit(0.0)).alias("s"),
        F.try_divide(F.sum("events"), F.sum("accepted")).alias("m"))
    b = F.col("b")
    edges = PROJECTION_SEEDS * (b + b * b + b * b * b)
    return by_depth, total.select(
        "targets_judged", "targets_with_candidates", steady_round(b, 2).alias("branching_factor"),
        steady_round(F.col("s"), 2).alias("stdev"), (b <= GATE_BRANCHING).alias("gate_passed"),
        F.floor(edges).alias("projected_group_edges"),
        steady_round(F.coalesce("m", F.lit(0.0)), 1).alias("mean_events_per_accepted_group"))


def candidate_profile(claims: DataFrame) -> DataFrame:
    """Claims per effect: how many effects, and the median, mean and largest count."""
    per = claims.groupBy("effect_id").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("seeds"), F.sum("n").alias("claims"), F.percentile("n", 0.5).alias("median"),
        steady_round(F.avg("n"), 2).alias("mean"), F.max("n").alias("max"))


def located(quote: Column, text: Column) -> Column:
    """Zero-based start of a verbatim quote, or null when it is empty or absent."""
    at = F.instr(text, quote)
    return F.when((quote != "") & (at > 0), at - 1)


def quote_spans(quotes: DataFrame, articles: DataFrame) -> DataFrame:
    """Each quote in the first article (by id) that holds it verbatim, with offsets and outlet.

    ``quotes`` has (claim_id, place, quote, article_ids), or (claim_id, quotes, article_ids) with all quotes of a claim as a list
    of (place, quote); place 0 is the primary quote and 1, 2, ... are supporting ones. ``articles`` has (article_id, text, outlet).
    A quote that no article holds has no row. A claim's quotes meet an article in one row, what is found there goes to the claim
    without the quotes' texts, and the result is dealt by claim already."""
    if "quotes" not in quotes.columns:
        quotes = quotes.select("claim_id", F.array(F.struct("place", "quote")).alias("quotes"), "article_ids")
    listed = quotes.select("claim_id", "quotes", F.explode("article_ids").alias("article_id"))
    at = lambda q: F.struct(
        q["place"].alias("place"), F.col("article_id"), located(q["quote"], F.col("text")).alias("start"), F.col("outlet"), F.length(q["quote"]).alias("n"))
    found = listed.join(articles.select("article_id", "text", "outlet"), "article_id").select(
        "claim_id", F.filter(F.transform("quotes", at), lambda s: s["start"].isNotNull()).alias("found"))
    # At one place of a text the shorter of two quotes is the lesser text too.
    own = F.array_sort(F.flatten(F.collect_list("found"))).alias("found")
    first = F.filter("found", lambda s, i: (i == 0) | ~s["place"].eqNullSafe(F.get("found", i - 1)["place"]))
    return found.groupBy("claim_id").agg(own).select("claim_id", F.explode(first).alias("f")).select(
        "claim_id", "f.place", "f.article_id", "f.outlet", "f.start", (F.col("f.start") + F.col("f.n")).alias("end"))


def claim_evidence(spans: DataFrame) -> DataFrame:
    """(claim_id, article_id, start, end, supporting, outlets): the primary span, the supporting
    spans in order, and how many outlets carry any of them. A claim lists a handful of quotes."""
    primary = lambda c: F.max(F.when(F.col("place") == 0, F.col(c))).alias(c)
    span = F.struct("place", "article_id", "start", "end")
    return spans.groupBy("claim_id").agg(
        primary("article_id"), primary("start"), primary("end"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, span))).alias("supporting"),
        F.count_distinct("outlet").cast("int").alias("outlets"))


def edge_records(claims: DataFrame, judgements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Judged claims as edges, each with the rubric rules it breaks.

    ``judgements`` has (claim_id, decision, relation, strength, evidence_quality,
    reject_reason); ``evidence`` comes from ``claim_evidence``. Corroboration counts the outlets whose
    text carries the link, in the primary or a supporting quote, not the copies of an article."""
    rows = claims.join(judgements, "claim_id").join(evidence, "claim_id", "left")
    accept, reject = F.col("decision") == "accept", F.col("decision") == "reject"
    in_list = lambda c, names: F.coalesce(F.col(c).isin(list(names)), F.lit(False))
    violations = F.array_compact(F.array(
        F.when(~accept & ~reject, "decision"),
        F.when(reject & ~in_list("reject_reason", REJECT_REASONS), "reject_reason"),
        F.when(accept & ~in_list("relation", RELATIONS), "relation"),
        F.when(accept & ~F.coalesce(F.col("strength").between(1, 3), F.lit(False)), "strength"),
        F.when(accept & ~in_list("evidence_quality", EVIDENCE_QUALITIES), "evidence_quality"),
        F.when(accept & F.col("start").isNull(), "evidence"),
    ))
    return rows.withColumn("violations", violations).select(
        "claim_id", F.col("cause_id").alias("source_id"), F.col("effect_id").alias("target_id"),
        "lag_days", F.when(accept, "ACCEPTED").when(reject, "REJECTED").alias("review_status"),
        F.when(accept, F.col("relation")).alias("relation_type"),
        F.when(accept, steady_round(F.col("strength") / 3, 4)).alias("final_strength"),
        F.when(accept, F.col("evidence_quality")).alias("evidence_quality"),
        F.when(reject, F.col("reject_reason")).alias("reject_reason"),
        "article_id", "start", "end", F.when(accept, F.col("supporting")).alias("supporting"),
        F.when(accept & F.col("start").isNotNull(), F.col("outlets")).otherwise(0).alias("corroboration_count"),
        "violations")


def label_violations(rows: DataFrame, domains: dict[str, Sequence[str]], key: str) -> DataFrame:
    """(key, rule) for values outside their label list, and for reviewed rows that lack a
    reviewer or a required label."""
    known = {"review_status": ("UNREVIEWED", "REVIEWED"), **domains}
    bad = [F.when(F.col(f).isNotNull() & ~F.col(f).isin(list(names)), f"invalid:{f}")
           for f, names in known.items()]
    required = ["protest_relevance", "body_quality", "scope"]
    reviewed = F.col("review_status") == "REVIEWED"
    lacking = [F.when(reviewed & F.col(f).isNull(), f"missing:{f}") for f in required]
    reviewer = F.when(reviewed & (F.trim(F.coalesce("reviewer", F.lit(""))) == ""), "missing:reviewer")
    return rows.select(key, F.explode(F.array_compact(F.array(*bad, *lacking, reviewer))).alias("rule"))
