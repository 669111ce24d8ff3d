"""Views of the test tables in the shapes the operators read.

The test tables are not coded news events, so each view derives the needed columns from
whole tables: no row is left out. ``event_view`` is the event table; ``claim_view`` is a
table of candidate cause claims between events, three earlier events per event, found by
an equi join on the unique event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.functions.codes import EVIDENCE_QUALITIES, REJECT_REASONS, RELATIONS
from antecede.functions.dates import day_of_date
from antecede.functions.ids import claim_key
from antecede.functions.timex import with_resolved_time, with_validity
from antecede.functions.urls import hostname, normalize_url, outcome_class


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_view(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    root = (
        F.when(kind == "view", "01").when(kind == "click", "04").when(kind == "signup", "14")
        .when(kind == "purchase", "06").otherwise("18")
    )
    quad = (
        F.when(kind.isin("view", "click"), "1").when(kind == "purchase", "2")
        .when(kind == "signup", "3").otherwise("4")
    )
    text = lambda column: column.cast("string")
    date = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("GlobalEventID"),
        day_of_date(date).alias("day"),
        date.alias("event_date"),
        F.concat(root, text(F.col("event_id") % 4)).alias("EventCode"),
        root.alias("EventRootCode"),
        quad.alias("QuadClass"),
        (F.col("value") / 10.0 - 10.0).alias("GoldsteinScale"),
        F.when(F.col("user_id") % 7 == 0, "")
        .otherwise(F.concat(F.lit("ACTOR"), text(F.col("user_id") % 40))).alias("Actor1Name"),
        F.concat(F.lit("C"), text(F.col("user_id") % 25)).alias("Actor1CountryCode"),
        F.concat(F.lit("GROUP"), text(F.col("event_id") % 30)).alias("Actor2Name"),
        F.when(F.col("event_id") % 11 == 0, "")
        .otherwise(F.concat(F.lit("C"), text(F.col("event_id") % 25))).alias("Actor2CountryCode"),
        F.concat(F.lit("G"), text(F.col("user_id") % 10)).alias("ActionGeo_CountryCode"),
        F.concat(F.lit("https://src"), text(F.col("event_id") % 20), F.lit(".example/a/"),
                 text(F.col("event_id"))).alias("SOURCEURL"),
    )


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    """A fetch status for every page; one residue has none, as after a timeout."""
    known = {0: 404, 1: 403, 2: 429, 3: 503, 4: 410, 6: 301, 7: 418}
    residue = F.col("page_id") % 13
    status = F.when(residue == 5, F.lit(None).cast("int"))
    for key, value in known.items():
        status = status.when(residue == key, value)
    return table(spark, folder, "pages").select("page_id", "url", status.otherwise(200).alias("status"))


def page_view(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as article documents with a fetch outcome."""
    outcome = outcome_class(F.col("status"))
    html = table(spark, folder, "pages").select("page_id", "html")
    return status_log(spark, folder).join(html, "page_id").select(
        F.col("page_id").alias("document_id"), normalize_url(F.col("url")).alias("url_key"),
        hostname(F.col("url")).alias("host"),
        F.when(outcome == "fetched", "extracted").otherwise(outcome).alias("status"),
        F.length("html").alias("text_length"),
        F.contains(F.lower("html"), F.lit("</html>")).alias("complete_html"),
        F.contains(F.lower("html"), F.lit("noarchive")).alias("paywalled"),
    )


def claim_view(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate cause claims: every event with three earlier events, at 0.9, 0.7 and 0.4 of
    its id. Ids rise with time, so no cause is later than its effect."""
    events = event_view(spark, folder).select("GlobalEventID", "EventRootCode", "event_date")
    e = F.col("GlobalEventID")
    pairs = events.select(
        e.alias("effect_id"), F.col("EventRootCode").alias("effect_type"),
        F.col("event_date").alias("effect_date"),
        F.posexplode(F.array(*[F.floor(e * k / 10) for k in (9, 7, 4)])).alias("pos", "cause_id"),
    ).filter("cause_id < effect_id").groupBy("effect_id", "effect_type", "effect_date", "cause_id").agg(
        (F.min("pos") + 1).alias("expansion_level"))
    causes = events.select(
        F.col("GlobalEventID").alias("cause_id"), F.col("EventRootCode").alias("cause_type"),
        F.col("event_date").alias("cause_date"))
    e, c = F.col("effect_id"), F.col("cause_id")
    strength = (e * 31 + c * 17) % 97
    return pairs.join(causes, "cause_id").withColumns({
        "claim_id": claim_key(e, c),
        "lag_days": F.datediff("effect_date", "cause_date"),
        "machine_strength": F.when(strength > 0, strength / 96.0),
    })


def judgement_view(claims: DataFrame, role: str = "primary") -> DataFrame:
    """A judgement of every claim; the second reader differs on some."""
    e, c = F.col("effect_id"), F.col("cause_id")
    flip = (c % 10 == 0) if role == "second" else F.lit(False)
    shift = F.when(c % 6 == 0, 1).otherwise(0) if role == "second" else F.lit(0)
    accepted = ((e + 2 * c) % 5 < 2) != flip
    pick = lambda names, n: F.element_at(
        F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return claims.select(
        "claim_id", "effect_id", "cause_id", "expansion_level",
        F.when(accepted, "accept").otherwise("reject").alias("decision"),
        F.when(accepted, pick(RELATIONS, e + c + shift)).alias("relation"),
        F.when(accepted, ((e + c) % 3 + 1).cast("int")).alias("strength"),
        F.when(accepted, pick(EVIDENCE_QUALITIES, e + 3 * c)).alias("evidence_quality"),
        F.when(~accepted, pick(REJECT_REASONS, e + 3 * c + shift)).alias("reject_reason"),
    )


def mention_view(spark: SparkSession, folder: str) -> DataFrame:
    """One mention per event: three to an article, with a time expression that resolves back
    to the event's day or the days around it."""
    date, n = F.col("event_date"), F.col("GlobalEventID")
    form = n % 7
    text = (
        F.when(form == 0, F.date_format(date, "'on' MMMM d, yyyy"))
        .when(form == 1, F.date_format(date, "d MMM"))
        .when(form == 2, F.date_format(date, "'on' EEEE"))
        .when(form == 3, F.lit("late yesterday")).when(form == 4, F.lit("this morning"))
        .when(form == 5, F.lit("last week")).otherwise(F.lit(None).cast("string"))
    )
    status = F.when(F.col("QuadClass") == "3", "announced").otherwise("asserted")
    label = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    rows = event_view(spark, folder).select(
        "event_date", n.alias("mention_id"), F.floor(n / 3).alias("article_id"),
        F.when(n % 13 != 0, F.col("EventRootCode")).alias("event_type"), status.alias("status"),
        F.array_compact(F.array(F.nullif("Actor1Name", F.lit("")))).alias("actors"),
        F.array("Actor2Name").alias("targets"), F.array(label("Place", n % 90)).alias("locations"),
        label("acted", n % 50).alias("action"), label("outlet", n % 20).alias("outlet"),
        text.alias("time_text"))
    resolved = with_resolved_time(rows, "time_text", "event_date", F.col("status") == "announced", "w")
    return resolved.select("*", "w.*").drop("w", "event_date")


def condition_view(spark: SparkSession, folder: str) -> DataFrame:
    """One condition mention per embedding."""
    n = F.col("vec_id")
    label = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    anchor = F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int"))
    since = F.when(n % 4 == 0, F.date_format(F.date_sub(anchor, 40), "'since' MMMM yyyy"))
    until = F.when(n % 5 == 0, F.date_format(F.date_add(anchor, 9), "'until' MMMM d, yyyy"))
    status = F.when(n % 5 == 0, "ended").otherwise("ongoing")
    rows = table(spark, folder, "embeddings").select(
        n.alias("id"), anchor.alias("anchor"), since.alias("since"), until.alias("until"),
        status.alias("status"), F.floor(n / 3).alias("article_id"), label("outlet", n % 7).alias("outlet"),
        label("shortage of item ", n % 25).alias("phrase"),
        F.when(F.col("label") % 2 == 0, "shortage").otherwise("policy").alias("kind"),
        F.when(n % 3 == 0, "protest_cause").otherwise("context").alias("role"),
        F.array(label("Holder", n % 20)).alias("holders"),
        F.array(F.lower(label("Holder", n % 20))).alias("words"), F.col("embedding").alias("vector"),
    )
    held = with_validity(rows, "since", "until", "status", "anchor", "v")
    return held.select("*", "v.*").drop("v", "anchor", "since", "until", "status")


def graph_inputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Claims, judgements, nodes and merge decisions in the store's shape."""
    claims = claim_view(spark, folder)
    e, c = F.col("effect_id"), F.col("cause_id")
    label = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    judged = judgement_view(claims)
    strength = F.round(F.col("strength") / 3, 4)
    row = lambda role, action, relation: judged.select(
        "claim_id", e, c, F.lit(role).alias("role"), action.alias("action"), relation.alias("relation_type"),
        strength.alias("strength"), "evidence_quality", ((e + c) % 4).cast("int").alias("corroboration_count"),
        F.lit("ai_assisted").alias("label_source"), F.concat(F.lit("reader"), (e % 3).cast("string")).alias("annotator"),
        F.concat(F.lit("2024-03-0"), (c % 9 + 1).cast("string")).alias("reviewed_at"))
    primary = row("primary", F.col("decision"), F.col("relation"))
    human = row("human-review", F.when((e + c) % 2 == 0, "accept").otherwise("reject"),
                F.when((e + c) % 4 == 0, "ESCALATES")).filter((e * 3 + c) % 29 == 0)
    blind = row("blind", F.when((e * 5 + c) % 3 != 0, "accept").otherwise("reject"),
                F.col("relation")).filter((e + c) % 4 == 0)
    events = event_view(spark, folder)
    n = F.col("GlobalEventID")
    nodes = events.select(
        n.alias("id"), F.lit("event").alias("kind"), "event_date", F.col("day").cast("string").alias("date"),
        F.array_compact(F.array(F.nullif("Actor1Name", F.lit("")), F.col("Actor2Name"))).alias("actors"),
        F.when(n % 3 == 0, "PARENTS_FOUND").when(n % 3 == 1, "NOT_YET_REVIEWED").alias("search_status"))
    # The effect's article carries most links, the cause's article every third, some claims name none.
    url = lambda k: F.concat(F.lit("https://src"), (k % 20).cast("string"), F.lit(".example/a/"), k.cast("string"))
    span = lambda k, held: F.when(held, F.struct(k.alias("article_id"), (k % 40).cast("int").alias("start"),
                                                 (k % 40 + 25).cast("int").alias("end"), url(k).alias("url")))
    evidence = claims.select("claim_id", F.explode(F.array_compact(F.array(
        span(e, (e + c) % 7 != 0), span(c, c % 3 == 0)))).alias("s")).select("claim_id", "s.*")
    later = events.filter(n > 0).filter(n % 50 < 3)
    merges = later.select(
        n.alias("node_a"), (n - 1).alias("node_b"), F.lit("same").alias("decision"),
        F.lit("2024-02-01").alias("reviewed_at"), F.concat(F.lit("m"), n.cast("string")).alias("external_id"))
    corrected = later.filter(n % 7 == 0).select(
        (n - 1).alias("node_a"), n.alias("node_b"), F.lit("different").alias("decision"),
        F.lit("2024-03-01").alias("reviewed_at"), F.concat(F.lit("n"), n.cast("string")).alias("external_id"))
    verdict = judged.select("claim_id", F.when(F.col("decision") == "accept", "accepted").otherwise("rejected").alias("verdict"))
    return {
        "claims": claims.join(verdict, "claim_id").select(
            "claim_id", "cause_id", "effect_id", F.lit("event").alias("cause_kind"), "verdict", "lag_days",
            "expansion_level", "cause_date", "effect_date",
            F.array_distinct(F.array(label(c), label(e))).alias("outlets")),
        "annotations": primary.unionByName(human).unionByName(blind), "nodes": nodes,
        "merges": merges.unionByName(corrected), "evidence": evidence,
    }
