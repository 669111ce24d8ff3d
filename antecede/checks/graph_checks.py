"""Graph compile, walks, grounding, explanation and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.checks import check
from antecede.checks.base import as_text, define, rounded, with_
from antecede.checks import review_checks as _review  # noqa: F401 - defines the claim tables
from antecede.checks.text_checks import STOP
from antecede.operators import causalgraph as G
from antecede.operators.similarity import bm25_scores
from antecede.plans import compile_graph as K8
from antecede.session import checkpointed
from antecede.sources.stand_ins import (
    claim_view, condition_view, event_view, graph_inputs, judgement_view, table,
)

define("jc", """
    SELECT f.*, c.cause_date, c.effect_date, (f.effect_id * 3 + f.cause_id) % 29 = 0 AS human,
           (f.effect_id + f.cause_id) % 2 = 0 AS human_ok,
           CASE WHEN (f.effect_id * 3 + f.cause_id) % 29 = 0 AND (f.effect_id + f.cause_id) % 4 = 0
                THEN 'ESCALATES' END AS human_relation,
           (f.effect_id + f.cause_id) % 4 = 0 AS blind, (f.effect_id * 5 + f.cause_id) % 3 <> 0 AS blind_ok
    FROM first f JOIN claims c USING (claim_id)""", "first", "claims")
define("ce", """
    SELECT claim_id, cause_id AS source, effect_id AS target, human AS human_verified,
           CASE WHEN coalesce(human_relation, relation) = 'CONTRIBUTES_TO' THEN 'MOTIVATES'
                ELSE coalesce(human_relation, relation) END AS relation,
           round(strength / 3, 4) AS strength, evidence_quality, lag_days, expansion_level,
           cause_date, effect_date
    FROM jc WHERE CASE WHEN human THEN human_ok ELSE decision = 'accept' END
      AND (human OR NOT blind OR blind_ok) AND evidence_quality IN ('explicit', 'implicit')""", "jc")
define("ge", """
    SELECT 'e:' || substr(sha256(source || '|' || target), 1, 16) AS id, source, target,
           arg_min(relation, (-strength, evidence_quality <> 'explicit', claim_id)) AS relation,
           max(strength) AS strength,
           arg_min(evidence_quality, (-strength, evidence_quality <> 'explicit', claim_id)) AS evidence_quality,
           bool_and(human_verified) AS human_verified, min(expansion_level) AS expansion_level,
           CASE WHEN source % 20 = target % 20 THEN 1 ELSE 2 END AS corroboration_count,
           min(cause_date) AS source_date, min(effect_date) AS target_date
    FROM ce GROUP BY source, target""", "ce")
define("gedges", "SELECT *, strength * CASE WHEN evidence_quality = 'explicit' THEN 1.0::DOUBLE "
       "ELSE 0.7::DOUBLE END * (1 + 0.1::DOUBLE * (corroboration_count - 1)) AS f FROM ge", "ge")
NO_MERGE = {**K8.DEFAULT_CONFIG, "merge_duplicates": False}


def plain_edges(spark, folder):
    """Accepted claims as edges, without merging nodes."""
    inputs = graph_inputs(spark, folder)
    accepted = G.claim_edges(inputs["claims"], inputs["annotations"], NO_MERGE)
    none = inputs["nodes"].filter("false").select(F.col("id").alias("node"), F.col("id").alias("rep"))
    return G.folded(accepted, none)[0]


@check("b17_c19_claim_edges", with_("ce", """
    SELECT claim_id, source, target, human_verified, relation, strength, evidence_quality FROM ce"""))
def claim_edges(spark, folder):
    """B17, C19 and H39."""
    inputs = graph_inputs(spark, folder)
    return G.claim_edges(inputs["claims"], inputs["annotations"], K8.DEFAULT_CONFIG).select(
        "claim_id", "source", "target", "human_verified", "relation", "strength", "evidence_quality")


define("mdec", """
    SELECT id - 1 AS a, id AS b, CASE WHEN id % 7 = 0 THEN 'different' ELSE 'same' END AS decision
    FROM (SELECT GlobalEventID AS id FROM ev) WHERE id > 0 AND id % 50 < 3""", "ev")


@check("e7_latest_decisions", with_("mdec", "SELECT a, b, decision FROM mdec"))
def latest_decisions(spark, folder):
    return G.latest_decisions(graph_inputs(spark, folder)["merges"])


@check("j3_folded_edges", with_("ce mdec", """
    , reach_pairs AS (SELECT a, b FROM mdec WHERE decision = 'same'),
    al AS (SELECT x.b AS node, least(x.a, coalesce(y.a, x.a), coalesce(z.a, x.a)) AS rep FROM reach_pairs x
           LEFT JOIN reach_pairs y ON y.b = x.a LEFT JOIN reach_pairs z ON z.b = y.a),
    mv AS (SELECT ce.*, coalesce(s.rep, source) AS s, coalesce(t.rep, target) AS t FROM ce
           LEFT JOIN al s ON s.node = source LEFT JOIN al t ON t.node = target)
    SELECT 'e:' || substr(sha256(s || '|' || t), 1, 16) AS id, s AS source, t AS target,
           arg_min(relation, (-strength, evidence_quality <> 'explicit', claim_id)) AS relation,
           max(strength) AS strength, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids,
           bool_and(human_verified) AS human_verified, min(expansion_level) AS expansion_level,
           count(DISTINCT h) AS corroboration_count
    FROM (SELECT *, NULL AS q FROM mv), LATERAL (SELECT unnest([source % 20, target % 20]) AS h)
    WHERE s <> t GROUP BY s, t""".replace(
        "string_agg(claim_id, ',' ORDER BY claim_id)", "string_agg(DISTINCT claim_id, ',' ORDER BY claim_id)")))
def folded_edges(spark, folder):
    inputs = graph_inputs(spark, folder)
    accepted = G.claim_edges(inputs["claims"], inputs["annotations"], K8.DEFAULT_CONFIG)
    same = G.latest_decisions(inputs["merges"]).filter("decision = 'same'").select("a", "b")
    alias, _ = G.representatives(same, inputs["nodes"], same.filter("false"))
    edges, _ = G.folded(accepted, alias)
    return edges.select("id", "source", "target", "relation", "strength", as_text("claim_ids").alias("claim_ids"),
                        "human_verified", "expansion_level", "corroboration_count")


@check("b17_min_corroboration", with_("ce", """
    SELECT claim_id FROM ce WHERE (source + target) % 4 >= 2"""))
def min_corroboration(spark, folder):
    """Claims whose judgement found two outlets or more; the counts run from none to three."""
    inputs = graph_inputs(spark, folder)
    return G.claim_edges(inputs["claims"], inputs["annotations"], {**K8.DEFAULT_CONFIG, "min_corroboration": 2}).select("claim_id")


@check("j3_edge_provenance", with_("ce mdec jc", """
    , reach_pairs AS (SELECT a, b FROM mdec WHERE decision = 'same'),
    al AS (SELECT x.b AS node, least(x.a, coalesce(y.a, x.a), coalesce(z.a, x.a)) AS rep FROM reach_pairs x
           LEFT JOIN reach_pairs y ON y.b = x.a LEFT JOIN reach_pairs z ON z.b = y.a),
    mv AS (SELECT ce.claim_id, ce.source AS c, ce.target AS e, cause_date, effect_date,
                  'e:' || substr(sha256(coalesce(s.rep, source) || '|' || coalesce(t.rep, target)), 1, 16) AS id
           FROM ce LEFT JOIN al s ON s.node = source LEFT JOIN al t ON t.node = target
           WHERE coalesce(s.rep, source) <> coalesce(t.rep, target)),
    sp AS (SELECT id, e AS art FROM mv WHERE (e + c) % 7 <> 0 UNION SELECT id, c FROM mv WHERE c % 3 = 0),
    rev AS (SELECT id, m.c FROM mv m UNION ALL SELECT id, c FROM mv m JOIN jc USING (claim_id) WHERE human
            UNION ALL SELECT id, c FROM mv m JOIN jc USING (claim_id) WHERE blind)
    SELECT id, claims, judged_relations, strftime(sd, '%Y-%m-%d') AS source_date, strftime(td, '%Y-%m-%d') AS target_date,
           coalesce(spans, 0) AS spans, coalesce(spans, 0) AS urls, coalesce(spans, 0) AS articles, coalesce(outlets, 0) AS outlets, reviews,
           '2024-03-0' || last AS last_review
    FROM (SELECT id, count(*) AS claims, min(cause_date) AS sd, min(effect_date) AS td,
                 string_agg(DISTINCT relation, ',' ORDER BY relation) AS judged_relations
          FROM mv JOIN (SELECT claim_id, relation FROM jc) USING (claim_id) GROUP BY id)
    LEFT JOIN (SELECT id, count(*) AS spans, count(DISTINCT art % 20) AS outlets FROM sp GROUP BY id) USING (id)
    JOIN (SELECT id, count(*) AS reviews, max(c % 9 + 1) AS last FROM rev GROUP BY id) USING (id)"""))
def edge_provenance(spark, folder):
    """What each folded edge rests on: spans, articles, URLs, outlets by host, dates, relations and reviews."""
    inputs = graph_inputs(spark, folder)
    accepted = G.claim_edges(inputs["claims"], inputs["annotations"], K8.DEFAULT_CONFIG)
    same = G.latest_decisions(inputs["merges"]).filter("decision = 'same'").select("a", "b")
    alias, _ = G.representatives(same, inputs["nodes"], same.filter("false"))
    found = G.provenance(checkpointed(accepted), alias, inputs["evidence"], inputs["annotations"]).summary
    day = lambda c: F.col(c).cast("string").alias(c)
    return found.select("id", "claims", as_text("judged_relations").alias("judged_relations"), day("source_date"), day("target_date"),
                        "spans", "urls", "articles", "outlets", "reviews", "last_review")


@check("j5_j2_compiled_counts")
def compiled_counts(spark, folder):
    """Counts and content version of the compiled graph."""
    inputs = graph_inputs(spark, folder)
    graph = K8.compile_graph(**{k: inputs[k] for k in ("claims", "annotations", "nodes", "merges")})
    return graph.counts.withColumns({
        "version": graph.version.select("version").scalar(),
        "merges_blocked": graph.blocked.agg(F.count("*")).scalar()})


@check("b16_default_view", with_("ge", """
    SELECT count(*) AS kept, (SELECT count(*) FROM ge) - count(*) AS hidden_implied FROM ge
    WHERE human_verified OR evidence_quality <> 'implicit'"""))
def default_view(spark, folder):
    edges = plain_edges(spark, folder)
    everything = edges.agg(F.count("*")).scalar()
    kept = G.without_unchecked_implied(edges).agg(F.count("*").alias("kept"))
    return kept.withColumn("hidden_implied", everything - F.col("kept"))


@check("g1_node_table", with_("ev", """
    SELECT kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
        SELECT 'event' AS kind, 'ce:' || GlobalEventID AS id FROM ev
        UNION ALL SELECT 'condition', 'cc:' || vec_id FROM embeddings) GROUP BY kind"""))
def node_table(spark, folder):
    events = event_view(spark, folder).select(
        F.concat(F.lit("ce:"), F.col("GlobalEventID").cast("string")).alias("id"), F.lit("event").alias("kind"),
        "event_date")
    conditions = condition_view(spark, folder).select(
        F.concat(F.lit("cc:"), F.col("id").cast("string")).alias("id"), F.lit("condition").alias("kind"))
    both = events.unionByName(conditions, allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@check("g2_level_union", with_("claims", """
    SELECT expansion_level AS level, count(*) AS claims FROM claims GROUP BY 1"""))
def level_union(spark, folder):
    claims = claim_view(spark, folder)
    levels = [claims.filter(F.col("expansion_level") == k).select("claim_id").withColumn("level", F.lit(k)) for k in (1, 2, 3)]
    both = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return both.groupBy("level").agg(F.count("*").alias("claims"))


HOPS = """
    , l1 AS (SELECT target AS t, source AS n FROM ge),
    l2 AS (SELECT DISTINCT l1.t, ge.source AS n FROM l1 JOIN ge ON ge.target = l1.n),
    l3 AS (SELECT DISTINCT l2.t, ge.source AS n FROM l2 JOIN ge ON ge.target = l2.n)"""


@check("j6_ancestors", with_("ge", HOPS + """
    SELECT t AS target, n AS node, min(d) AS depth FROM (
        SELECT GlobalEventID AS t, GlobalEventID AS n, 0 AS d FROM ev UNION ALL SELECT t, n, 1 FROM l1
        UNION ALL SELECT t, n, 2 FROM l2 UNION ALL SELECT t, n, 3 FROM l3) GROUP BY t, n"""))
def ancestors(spark, folder):
    targets = event_view(spark, folder).select(F.col("GlobalEventID").alias("target"))
    return G.reached(checkpointed(plain_edges(spark, folder)), targets)


@check("j6_subgraph_edges", with_("ge", HOPS + """
    SELECT DISTINCT w.t AS target, ge.id FROM (
        SELECT GlobalEventID AS t, GlobalEventID AS n FROM ev UNION SELECT t, n FROM l1 UNION SELECT t, n FROM l2) w
    JOIN ge ON ge.target = w.n"""))
def subgraph_edges(spark, folder):
    """The edges of the same walks, from the nodes' own rows."""
    edges = checkpointed(plain_edges(spark, folder))
    targets = event_view(spark, folder).select(F.col("GlobalEventID").alias("target"))
    return G.subgraph_edges(edges, G.reached(edges, targets, G.MAX_DEPTH - 1))


PATHS = """
    , p1 AS (SELECT target AS t, source AS e, id AS ids, f AS w, [target, source] AS ns FROM gedges),
    p2 AS (SELECT p1.t, g.source AS e, g.id || ',' || ids AS ids, w * f AS w, list_append(ns, g.source) AS ns
           FROM p1 JOIN gedges g ON g.target = p1.e),
    p3 AS (SELECT p2.t, g.source AS e, g.id || ',' || ids AS ids, w * f AS w, list_append(ns, g.source) AS ns
           FROM p2 JOIN gedges g ON g.target = p2.e),
    paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


@check("j7_j8_chains", with_("gedges", PATHS + """
    SELECT t AS target, e AS "end", ids AS edges, round(w, 9) AS weight FROM paths"""))
def chains(spark, folder):
    targets = event_view(spark, folder).select(F.col("GlobalEventID").alias("target"))
    found = G.chains(checkpointed(plain_edges(spark, folder)), targets)
    return rounded(found.select("target", "end", as_text("edges").alias("edges"), "weight"))


TOKENS = f"""list_transform(list_filter(regexp_extract_all(lower(X), '[a-z0-9]+'),
    lambda x: length(x) > 2 AND x NOT IN ('{STOP}')),
    lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN x[:-2] ELSE x END)"""
define("ndoc", f"""
    SELECT GlobalEventID AS node, {TOKENS.replace('X', "d.title")} AS ts
    FROM ev JOIN (SELECT doc_id, text AS title FROM documents) d
      ON d.doc_id = GlobalEventID % (SELECT count(*) FROM documents)""", "ev")
# Every item, and every item read backwards, which few words match.
define("asked", "SELECT item_id AS question_id, text FROM benchmark UNION ALL SELECT -1 - item_id, reverse(text) FROM benchmark")
define("qs", f"""
    WITH q AS (SELECT DISTINCT question_id, unnest({TOKENS.replace('X', 'text')}) AS term FROM asked),
    post AS (SELECT node, len(ts) AS dl, term, count(*) AS tf FROM (SELECT node, ts, unnest(ts) AS term FROM ndoc)
             GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    s AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM ndoc)
    SELECT question_id, node, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
    FROM q JOIN post USING (term) JOIN df USING (term), s GROUP BY ALL""", "ndoc", "asked")
# Components by repeated minimum over neighbours, enough rounds for these shallow graphs.
define("gsym", "SELECT source AS x, target AS y FROM ge UNION SELECT target, source FROM ge", "ge")
LABELS = ["SELECT GlobalEventID AS node, GlobalEventID AS c FROM ev"]
define("lab0", LABELS[0], "ev")
ROUNDS = 80
for _k in range(1, ROUNDS + 1):
    define(f"lab{_k}", f"""
        SELECT node, least(any_value(l.c), coalesce(min(m.c), any_value(l.c))) AS c FROM lab{_k - 1} l
        LEFT JOIN gsym ON x = node LEFT JOIN (SELECT node AS nn, c FROM lab{_k - 1}) m ON m.nn = y GROUP BY node""",
           f"lab{_k - 1}", "gsym")
define("glab", f"SELECT * FROM lab{ROUNDS}", f"lab{ROUNDS}")
define("ground", """
    SELECT question_id, c AS cluster, best AS top,
           (SELECT count(*) FROM (SELECT q.question_id, l.c, max(q.score) AS b FROM qs q JOIN glab l USING (node)
                                  GROUP BY ALL) o WHERE o.question_id = k.question_id AND o.b >= 0.8 * k.best)
             AS matching_clusters
    FROM (SELECT q.question_id, l.c, max(q.score) AS best,
                 row_number() OVER (PARTITION BY q.question_id ORDER BY max(q.score) DESC, l.c) AS rn
          FROM qs q JOIN glab l USING (node) GROUP BY q.question_id, l.c) k WHERE rn = 1""", "qs", "glab")
define("aims", """
    SELECT q.question_id, q.node AS target, g.top FROM qs q JOIN glab l USING (node)
    JOIN ground g ON g.question_id = q.question_id AND g.cluster = l.c WHERE q.score >= 0.5 * g.top""",
       "qs", "glab", "ground")


def question_inputs(spark, folder):
    nodes = event_view(spark, folder).select(F.col("GlobalEventID").alias("id"))
    titles = table(spark, folder, "documents").select(
        "doc_id", "text")
    texts = nodes.select(F.col("id").alias("node"), (F.col("id") % titles.count()).alias("text"))
    copies = texts.groupBy(F.col("text").alias("doc_id")).agg(F.count("*").alias("copies"))
    docs = titles.join(copies, "doc_id").select(F.col("doc_id").alias("node"), "text", "copies")
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    backwards = items.select((-1 - F.col("question_id")).alias("question_id"), F.reverse("question").alias("question"))
    return graph_inputs(spark, folder)["nodes"], docs, items.unionByName(backwards), texts


@check("j1_graph_clusters", with_("glab", "SELECT node, c AS component FROM glab"))
def graph_clusters(spark, folder):
    nodes = event_view(spark, folder).select(F.col("GlobalEventID").alias("id"))
    return K8.clusters(nodes, plain_edges(spark, folder))


def grounding_of(spark, folder, chosen=None):
    nodes, docs, questions, texts = question_inputs(spark, folder)
    scores = checkpointed(bm25_scores(docs, questions))
    labels = checkpointed(K8.clusters(nodes, plain_edges(spark, folder)))
    return G.grounded(scores, labels, questions, chosen(questions) if chosen else None, texts)[0], scores, labels, texts


@check("j9_grounding", with_("ground asked", """
    SELECT a.question_id, cluster, top, coalesce(matching_clusters, 0) AS matching_clusters,
           CASE WHEN cluster IS NULL THEN 'no_match' WHEN matching_clusters > 1 THEN 'clarify' ELSE 'ok' END AS status
    FROM asked a LEFT JOIN ground g ON g.question_id = a.question_id"""))
def grounding(spark, folder):
    return grounding_of(spark, folder)[0]


@check("j9_chosen_cluster", with_("ground asked", """
    SELECT a.question_id, CASE WHEN b.top IS NOT NULL THEN p.cluster END AS cluster, b.top, coalesce(matching_clusters, 0) AS matching_clusters,
           CASE WHEN b.top IS NULL THEN 'no_match' ELSE 'ok' END AS status
    FROM asked a JOIN (SELECT question_id, CASE WHEN question_id % 2 = 0 THEN 0 ELSE 3 END AS cluster FROM asked) p USING (question_id)
    LEFT JOIN ground g ON g.question_id = a.question_id
    LEFT JOIN (SELECT q.question_id, l.c, max(q.score) AS top FROM qs q JOIN glab l USING (node) GROUP BY ALL) b
      ON b.question_id = a.question_id AND b.c = p.cluster"""))
def chosen_cluster(spark, folder):
    """Every question answered for a cluster the asker picked."""
    pick = F.when(F.col("question_id") % 2 == 0, 0).otherwise(3).cast("long")
    return grounding_of(spark, folder, lambda questions: questions.select("question_id", pick.alias("cluster")))[0]


@check("j9_cluster_cards", with_("ground", """
    , lead AS (SELECT q.question_id, l.c AS cluster, max(q.score) AS score, arg_max(q.node, (q.score, q.node)) AS lead_node
               FROM qs q JOIN glab l USING (node) JOIN ground g ON g.question_id = q.question_id
               WHERE g.matching_clusters > 1 GROUP BY q.question_id, l.c),
    ranked AS (SELECT lead.*, row_number() OVER (PARTITION BY lead.question_id ORDER BY score DESC, lead.cluster) AS rank
               FROM lead JOIN ground g ON g.question_id = lead.question_id WHERE score >= 0.8 * g.top),
    shape AS (SELECT l.c AS cluster, count(*) AS nodes, min(event_date) AS a, max(event_date) AS b
              FROM glab l JOIN ev ON GlobalEventID = node GROUP BY l.c)
    SELECT r.question_id, r.rank, r.cluster, lead_node, EventCode || ' ' || Actor2Name AS label, nodes, round(score, 4) AS score,
           strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day
    FROM ranked r JOIN shape s ON s.cluster = r.cluster JOIN ev ON GlobalEventID = lead_node WHERE rank <= 5"""))
def cluster_cards(spark, folder):
    found, scores, labels, texts = grounding_of(spark, folder)
    names = event_view(spark, folder).select(
        F.col("GlobalEventID").alias("node"), F.concat_ws(" ", "EventCode", "Actor2Name").alias("label"),
        F.col("event_date").cast("string").alias("day"))
    return G.cluster_cards(found, scores, labels, names, texts=texts)


define("shown", PATHS.replace("    , p1", "    WITH p1", 1) + """
    , fit AS (SELECT question_id, top, ids, e, w, max(coalesce(s.score, 0)) AS rel FROM (
                SELECT a.question_id, a.top, p.ids, p.e, p.w, unnest(p.ns) AS node FROM aims a JOIN paths p ON p.t = a.target)
              LEFT JOIN qs s USING (question_id, node) GROUP BY ALL),
    sc AS (SELECT question_id, e, ids, round(w * (0.5 + 0.5 * rel / top), 6) AS score FROM fit),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, e
              ORDER BY score DESC, string_split(ids, ',')) AS rn FROM sc) WHERE rn = 1)
    SELECT question_id, e AS "end", score, ids AS edges, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, string_split(ids, ',')) AS rank FROM b)
    WHERE rank <= 5""", "aims", "gedges", "qs")


@check("k8_j10_explain", with_("shown", "SELECT * FROM shown"))
def explain(spark, folder):
    """E17 included: best chain per far end, then the best five."""
    nodes, docs, questions, texts = question_inputs(spark, folder)
    edges = checkpointed(plain_edges(spark, folder))
    _, shown, _ = K8.explain(nodes, edges, questions, docs, texts=texts)
    return shown.select("question_id", "end", "score", as_text("edges").alias("edges"), "rank")


@check("j10_coverage", with_("shown ge", """
    , q0 AS (SELECT DISTINCT question_id, target AS n FROM aims),
    q1 AS (SELECT DISTINCT question_id, source AS n FROM q0 JOIN ge ON ge.target = n),
    q2 AS (SELECT DISTINCT question_id, source AS n FROM q1 JOIN ge ON ge.target = n),
    q3 AS (SELECT DISTINCT question_id, source AS n FROM q2 JOIN ge ON ge.target = n),
    every AS (SELECT * FROM q0 UNION SELECT * FROM q1 UNION SELECT * FROM q2 UNION SELECT * FROM q3),
    es AS (SELECT DISTINCT question_id, id, strength, n FROM (SELECT * FROM q0 UNION SELECT * FROM q1 UNION SELECT * FROM q2)
           JOIN ge ON ge.target = n),
    drawn AS (SELECT DISTINCT question_id, unnest(string_split(edges, ',')) AS id, true AS drawn FROM shown),
    sums AS (SELECT es.question_id, round(coalesce(sum(strength) FILTER (drawn) / sum(strength), 0), 4) AS strength_share,
                    count(*) FILTER (drawn AND q0.n IS NOT NULL) AS direct_shown, count(*) FILTER (q0.n IS NOT NULL) AS direct_total,
                    count(*) AS edges_in_subgraph
             FROM es LEFT JOIN drawn ON drawn.question_id = es.question_id AND drawn.id = es.id
             LEFT JOIN q0 ON q0.question_id = es.question_id AND q0.n = es.n GROUP BY es.question_id)
    SELECT e.question_id, coalesce(any_value(strength_share), 0) AS strength_share, coalesce(any_value(direct_shown), 0) AS direct_shown,
           coalesce(any_value(direct_total), 0) AS direct_total, coalesce(any_value(edges_in_subgraph), 0) AS edges_in_subgraph,
           count(*) AS nodes_in_subgraph, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (n % 3 <> 0), '') AS not_searched
    FROM every e LEFT JOIN sums s ON s.question_id = e.question_id GROUP BY e.question_id"""))
def covered(spark, folder):
    """What the shown chains account for, and the nodes whose causes nobody has looked for."""
    nodes, docs, questions, texts = question_inputs(spark, folder)
    found = K8.explain(nodes, checkpointed(plain_edges(spark, folder)), questions, docs, texts=texts)[2]
    return found.withColumn("not_searched", as_text("not_searched"))


@check("h36_explanation_text")
def explanation_text(spark, folder):
    nodes, docs, questions, texts = question_inputs(spark, folder)
    edges = checkpointed(plain_edges(spark, folder))
    _, shown, covered = K8.explain(nodes, edges, questions, docs, direction="effects", texts=texts)
    labels = nodes.select(F.col("id").alias("node"), G.node_label(
        F.concat_ws(" ", F.array_join("actors", ", "), F.lit("acted")), F.col("actors"), F.col("kind")).alias("label"))
    return G.chain_sentences(shown, edges, labels).join(covered, "question_id")


@check("f7_topics", with_("ge", """
    , d1 AS (SELECT source AS s, target AS n, id FROM ge),
    d2 AS (SELECT d1.s, g.target AS n, g.id FROM d1 JOIN ge g ON g.source = d1.n),
    d3 AS (SELECT d2.s, g.target AS n, g.id FROM d2 JOIN ge g ON g.source = d2.n)
    SELECT 'effects' AS direction, node, links AS downstream_links, row_number() OVER (ORDER BY links DESC, node) AS place FROM (
        SELECT s AS node, count(DISTINCT id) AS links
        FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY s)
    UNION ALL SELECT 'causes', GlobalEventID, NULL, row_number() OVER (ORDER BY day DESC, GlobalEventID DESC)
    FROM ev WHERE GlobalEventID IN (SELECT target FROM ge WHERE expansion_level = 1)"""))
def topics(spark, folder):
    edges = checkpointed(plain_edges(spark, folder))
    nodes = graph_inputs(spark, folder)["nodes"]
    both = [K8.topics(edges, nodes, d).withColumn("direction", F.lit(d)) for d in ("effects", "causes")]
    return both[0].unionByName(both[1], allowMissingColumns=True).select("direction", "node", "downstream_links", "place")


define("xe", """
    SELECT claim_id, cause_id AS source, effect_id AS target, cause_date, effect_date,
           CASE WHEN decision = 'accept' THEN 'ACCEPTED' ELSE 'REJECTED' END AS review_status
    FROM jc WHERE (effect_id + cause_id) % 9 <> 0""", "jc")


def expansion(spark, folder):
    """Judged edges of an unfinished expansion: a ninth of the claims wait for a judgement."""
    claims = claim_view(spark, folder)
    judged = judgement_view(claims).select("claim_id", F.when(F.col("decision") == "accept", "ACCEPTED").otherwise(
        "REJECTED").alias("review_status"))
    rows = claims.withColumnsRenamed({"cause_id": "source", "effect_id": "target"})
    edges = rows.filter((F.col("source") + F.col("target")) % 9 != 0).join(judged, "claim_id")
    nodes = event_view(spark, folder).select(
        F.col("GlobalEventID").alias("node"), F.lit("event").alias("kind"),
        F.when(F.col("QuadClass") == "3", "announced").otherwise("asserted").alias("status"),
        F.col("event_date").alias("node_day"))
    return rows, edges, nodes


@check("g5_expansion_frontier", with_("xe", """
    SELECT source AS node, coalesce(CASE WHEN event_date < DATE '2024-01-03' THEN 'OUT_OF_SCOPE'
           WHEN QuadClass = '3' THEN 'UNVERIFIABLE' END, '') AS stopped
    FROM (SELECT DISTINCT source FROM xe WHERE review_status = 'ACCEPTED') JOIN ev ON GlobalEventID = source
    WHERE source NOT IN (SELECT target FROM xe)"""))
def expansion_frontier(spark, folder):
    _, edges, nodes = expansion(spark, folder)
    done = edges.select(F.col("target").alias("node")).distinct()
    return G.expansion_frontier(edges, done, nodes, "2024-01-03").withColumn(
        "stopped", F.coalesce("stopped", F.lit("")))


define("xstatus", """
    WITH reached AS (SELECT DISTINCT source AS node FROM xe WHERE review_status = 'ACCEPTED'
                  UNION SELECT GlobalEventID FROM ev WHERE EventRootCode = '14')
    SELECT node, CASE WHEN node IN (SELECT source FROM xe WHERE review_status = 'ACCEPTED')
                       AND node NOT IN (SELECT target FROM xe) AND event_date < DATE '2024-01-03' THEN 'OUT_OF_SCOPE'
                      WHEN node IN (SELECT source FROM xe WHERE review_status = 'ACCEPTED')
                       AND node NOT IN (SELECT target FROM xe) AND QuadClass = '3' THEN 'UNVERIFIABLE'
                      WHEN node IN (SELECT target FROM xe WHERE review_status = 'ACCEPTED') THEN 'PARENTS_FOUND'
                      WHEN node IN (SELECT effect_id FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM xe))
                        OR node NOT IN (SELECT target FROM xe) THEN 'NOT_YET_REVIEWED'
                      ELSE 'NO_SUPPORTED_PARENT_FOUND' END AS search_status
    FROM reached JOIN ev ON GlobalEventID = node""", "xe", "ev", "claims")


@check("j14_search_statuses", with_("xstatus", "SELECT * FROM xstatus"))

def search_statuses(spark, folder):
    return statuses_of(spark, folder, *expansion(spark, folder))


def statuses_of(spark, folder, claims, edges, nodes):
    seeds = event_view(spark, folder).filter("EventRootCode = '14'").select(F.col("GlobalEventID").alias("node"))
    found = edges.filter("review_status = 'ACCEPTED'").select(F.col("source").alias("node")).unionByName(seeds)
    searched = edges.select(F.col("target").alias("node")).distinct()
    frontier = G.expansion_frontier(edges, searched, nodes, "2024-01-03")
    return G.search_statuses(found, searched, claims, edges, frontier)


@check("d35_convergence", with_("xe", """
    SELECT source AS node, count(*) AS effects_explained FROM xe WHERE review_status = 'ACCEPTED' GROUP BY 1"""))
def convergence(spark, folder):
    return G.convergence(expansion(spark, folder)[1])


@check("j13_d37_depths", with_("xe", """
    SELECT node, min(depth) AS depth FROM walk GROUP BY node""", """walk(node, depth) AS (
        SELECT GlobalEventID, 0 FROM ev WHERE EventRootCode = '14'
        UNION SELECT e.source, w.depth + 1 FROM walk w JOIN xe e ON e.target = w.node
        WHERE e.review_status = 'ACCEPTED')"""))
def depths(spark, folder):
    _, edges, _ = expansion(spark, folder)
    seeds = event_view(spark, folder).filter("EventRootCode = '14'").select(F.col("GlobalEventID").alias("node"))
    return G.shortest_depths(edges.filter("review_status = 'ACCEPTED'"), seeds)


@check("d37_expansion_summary", with_("xe xstatus jc", """
    , acc AS (SELECT * FROM xe WHERE review_status = 'ACCEPTED'),
    lv AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
    sh AS (SELECT source AS node, count(*) AS n FROM acc GROUP BY source)
    SELECT 'accepted_edges' AS measure, '' AS key, count(*) AS value FROM acc
    UNION ALL SELECT 'edges_by_level', CAST(expansion_level AS VARCHAR), count(*) FROM acc JOIN jc USING (claim_id) GROUP BY expansion_level
    UNION ALL SELECT 'max_depth', '', max(depth) FROM lv
    UNION ALL SELECT 'nodes_by_depth', CAST(depth AS VARCHAR), count(*) FROM lv GROUP BY depth
    UNION ALL SELECT 'nodes_reached', '', count(*) FROM xstatus
    UNION ALL SELECT 'search_status', search_status, count(*) FROM xstatus GROUP BY search_status
    UNION ALL SELECT 'shared_causes', '', count(*) FROM sh WHERE n > 1
    UNION ALL SELECT 'most_shared', CAST(node AS VARCHAR), n FROM (SELECT * FROM sh ORDER BY n DESC, node LIMIT 5)""",
    """walk(node, depth) AS (
        SELECT GlobalEventID, 0 FROM ev WHERE EventRootCode = '14'
        UNION SELECT e.source, w.depth + 1 FROM walk w JOIN xe e ON e.target = w.node WHERE e.review_status = 'ACCEPTED')""").replace(
    "    , acc AS", ", acc AS"))
def expansion_totals(spark, folder):
    """Edges by level, nodes by depth and status, shared causes."""
    claims, edges, nodes = (checkpointed(df) for df in expansion(spark, folder))
    seeds = event_view(spark, folder).filter("EventRootCode = '14'").select(F.col("GlobalEventID").alias("node"))
    return G.expansion_summary(claims, edges, statuses_of(spark, folder, claims, edges, nodes),
                               G.shortest_depths(edges.filter("review_status = 'ACCEPTED'"), seeds))


@check("j12_cycle", with_("xe", """
    SELECT 'accepted' AS graph, CAST(count(*) > 0 AS INTEGER) AS cycles FROM below WHERE start = node
    UNION ALL SELECT 'with conditions', CAST(count(*) > 0 AS INTEGER) FROM around WHERE n = (SELECT min(target) FROM acc WHERE target % 5 = 0)""", """
    acc AS (SELECT DISTINCT source, target FROM xe WHERE review_status = 'ACCEPTED'),
    below(start, node) AS (SELECT source, target FROM acc UNION SELECT b.start, a.target FROM below b JOIN acc a ON a.source = b.node),
    tied AS (SELECT source, target FROM acc UNION SELECT target, source FROM acc WHERE target % 5 = 0),
    around(n) AS (SELECT t.target FROM tied t WHERE t.source = (SELECT min(target) FROM acc WHERE target % 5 = 0)
                  UNION SELECT t.target FROM around a JOIN tied t ON t.source = a.n)"""))
def cycle(spark, folder):
    """Accepted edges point from lower to higher ids, so they hold no cycle. With undated conditions that
    lead from every effect back to a cause, a cycle must come out: each of its nodes left and entered once."""
    _, edges, _ = expansion(spark, folder)
    dated = edges.filter("review_status = 'ACCEPTED'").select(
        "source", "target", F.col("cause_date").alias("source_date"), F.col("effect_date").alias("target_date"))
    none = F.lit(None).cast("date")
    back = dated.filter("target % 5 = 0").select(
        F.col("target").alias("source"), F.col("source").alias("target"), none.alias("source_date"), none.alias("target_date"))

    def closed(graph, rows):
        found = G.cycle_edges(rows)
        ends = found.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            found.select(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        whole = per.agg(F.coalesce(F.min((F.col("out") == 1) & (F.col("into") == 1)).cast("int"), F.lit(0)).alias("cycles"))
        return whole.select(F.lit(graph).alias("graph"), "cycles")

    return closed("accepted", dated).unionByName(closed("with conditions", dated.unionByName(back)))
