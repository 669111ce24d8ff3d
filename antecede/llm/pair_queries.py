"""Queries of the operators on pairs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antecede.llm import signature_trees
from antecede.llm.common import table
from antecede.llm.registry import query


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every whole text under Jaccard 0.85 of distinct four-word shingles."""
    return signature_trees.classes(table(spark, folder, "documents").select("doc_id", "text"), width=4, percent=85)
