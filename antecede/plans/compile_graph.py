"""Compile judged claims into a graph, and answer questions over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from antecede.functions.ids import content_version
from antecede.operators import causalgraph as G
from antecede.operators.components import connected_components, label_all
from antecede.operators.ordering import with_position
from antecede.operators.similarity import bm25_scores
from antecede.session import checkpointed

# The published graph configuration.
DEFAULT_CONFIG = {
    "relation_map": {"CONTRIBUTES_TO": "MOTIVATES"}, "kinds": ["event", "condition"],
    "evidence_quality": ["explicit", "implicit"], "min_strength": 0, "min_corroboration": 0,
    "include_ai_labels": True,
}


@dataclass
class CompiledGraph:
    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame
    blocked: DataFrame
    version: DataFrame


def compile_graph(claims: DataFrame, annotations: DataFrame, nodes: DataFrame, merges: DataFrame,
                  config: dict | None = None) -> CompiledGraph:
    config = DEFAULT_CONFIG if config is None else config
    accepted = checkpointed(G.claim_edges(claims, annotations, config))
    decided = G.latest_decisions(merges).filter("decision = 'same'")
    known = nodes.select("id")
    same = decided.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(
        known.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    if not config.get("merge_duplicates", True):
        same = same.filter("false")
    # A person accepting a link between two nodes says they are different things.
    apart = accepted.filter("human_verified").select(F.col("source").alias("a"), F.col("target").alias("b"))
    alias, blocked = G.representatives(same, nodes, apart)
    alias = checkpointed(alias)
    edges, loops = G.folded(accepted, alias)
    edges = checkpointed(edges)
    used = G.merged_nodes(nodes, edges, alias)
    human_rejected = annotations.filter("role = 'human-review' AND action = 'reject'")
    many = lambda df: df.agg(F.count("*")).scalar()
    counts = claims.agg(
        F.count("*").alias("claims"), F.count_if(F.col("verdict") == "accepted").alias("accepted_claims"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected_claims"),
    ).withColumns({
        "claim_edges": many(accepted), "edges": many(edges),
        "human_verified_edges": many(edges.filter("human_verified")),
        "human_rejected_claims": many(human_rejected), "nodes": many(used),
        "nodes_merged_away": many(alias), "self_loops_dropped": many(loops),
    })
    return CompiledGraph(used, edges, counts, blocked, content_version(edges))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every node."""
    return label_all(nodes.select(F.col("id").alias("node")), connected_components(edges, "source", "target"), "node")


def explain(graph_nodes: DataFrame, edges: DataFrame, questions: DataFrame, docs: DataFrame, keep: int = 5,
            direction: str = "causes", chosen: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grounding, shown chains, coverage) for many questions at once.

    ``docs`` has (node, text) and ``graph_nodes`` (id, search_status). Each question is answered for its best cluster, or
    the one in ``chosen``; the grounding says when another matches about as well or none does. Where many nodes hold one text,
    ``texts`` (node, text) says which, and ``docs`` has (node: the text's id, text, copies), so that each text is scored once."""
    scores = checkpointed(bm25_scores(docs, questions))
    grounding, targets = G.grounded(scores, clusters(graph_nodes, edges), questions, chosen, texts)
    targets = checkpointed(targets)
    shown = checkpointed(G.explained(edges, targets, scores, keep, direction, texts))
    return grounding, shown, G.coverage(edges, graph_nodes, targets, shown, direction)


def topics(edges: DataFrame, nodes: DataFrame, direction: str = "causes") -> DataFrame:
    """Starting points with their place in the list: traced events newest first, or causes by how much lies
    downstream. ``nodes`` has (id, date)."""
    if direction == "effects":
        starts = edges.select(F.col("source").alias("target")).distinct()
        sizes = G.subgraph_sizes(edges, G.reached(edges, starts, G.MAX_DEPTH - 1, "effects"), direction="effects")
        rows = sizes.select(F.col("target").alias("node"), F.col("n_edges").alias("downstream_links"))
        return with_position(rows, [-F.col("downstream_links"), F.col("node")], "place")
    traced = edges.filter("expansion_level = 1").select(F.col("target").alias("id")).distinct()
    rows = traced.join(nodes, "id").select(F.col("id").alias("node"), "date")
    rows = with_position(rows, [F.coalesce("date", F.lit("")), F.col("node")], "from_oldest")
    return rows.withColumn("place", rows.agg(F.count("*")).scalar() + 1 - F.col("from_oldest")).drop("from_oldest")
