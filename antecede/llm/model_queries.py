"""Queries of the operators that score or encode texts with a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import language, pieces, quality_model, toxicity
from antecede.llm.common import fold_is, table
from antecede.llm.registry import query

TOXIC_FROM = GOOD_FROM = 0.3


@query("op5_sentencepiece_sampling")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled piece ids of every whole text, and whether they decode to it."""
    docs = pieces.with_pieces(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), "piece_ids",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text; rows with crc32(doc_id) mod 4 = 2 are never learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, folder, "labels"))
    return toxicity.scores(docs, model, ["doc_id"]).select(
        "doc_id", fold_is("doc_id", toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole text; rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold_is("doc_id", 5, 0)
    weights = quality_model.fitted(docs.filter(~held_out), table(spark, folder, "labels").filter(~held_out))
    return quality_model.scored(docs, weights).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text; rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold_is("doc_id", 3, 1)
    model = language.fitted(docs.filter(~held_out))
    return language.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")
