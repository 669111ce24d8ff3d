"""Filter interaction audit: what each filter removes in every order, by min-plus removal ranks.

A document's failed filters are one mask. The mask matrix (0 where a filter fails, never where it passes) is combined
with the inverse-permutation matrix of each order (the place of every filter) by minimum of sums; the result is the
step that removes the mask in that order. These steps scatter the counts of the masks into removals, losses and
redundancies. Documents are counted by mask first, so the matrix work of a part has at most 2^k rows for k filters,
whatever the input; an order lists all k filters, so k should stay small (k! orders come out).

``repeats_counted`` finds texts that a smaller id holds too. Texts stay where they are: only digests, ids and masks are
shuffled. Rows of one text and one part, mask and label pair are combined before the shuffle, so a text that a third of
all rows hold is a few rows.

Defined results: a null text is empty; a null part is the empty string; a row without an id has no labels, repeats
nothing and is repeated by nothing; rows that share an id count each, and do not repeat each other; a document has a label when
any of its label rows has it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.llm.common import words_of

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_checks(text: Column) -> dict[str, Column]:
    """Failure conditions of one text: A too short, B repetitive, C upper case, D symbols."""
    words = words_of(text)
    held = F.coalesce(text, F.lit(""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(held, "[^A-Z]+", "")) > 10 * F.length(held),
        "D": held.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, checks: dict[str, Column], part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask): bit i of the mask is set where check i fails."""
    mask = sum((F.when(check, 1 << i).otherwise(0) for i, check in enumerate(checks.values())), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), mask.alias("mask"))


def repeats_counted(rows: DataFrame, labels: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by mask; ``bit`` is set where a smaller id has the same text."""
    alike = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("rows"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic")).withColumn("key", F.col("doc_id").cast("string"))
    # Rows without an id match no label; a key of their own spreads them over the tasks.
    keyed = alike.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("digest"))))
    marked = keyed.join(marks.drop("doc_id"), "key", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    groups = marked.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("low"), F.min_by("rows", "doc_id").alias("n_low"))
    # A text has a row for each part and label pair at most.
    first = F.min("low").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", first).withColumn("repeating", F.col("n") - F.col("unnamed") - F.when(
        F.col("low") == F.col("first"), F.col("n_low")).otherwise(0))
    halves = F.explode(F.array(F.struct((F.col("n") - F.col("repeating")).alias("n"), F.col("mask").alias("mask")),
                               F.struct(F.col("repeating").alias("n"), F.col("mask").bitwiseOR(F.lit(1 << bit)).alias("mask"))))
    counted = groups.select("part", "is_good", "is_toxic", halves.alias("half"))
    weighed = lambda c: F.sum(F.when(F.col(c), F.col("half.n")).otherwise(0))
    return counted.groupBy("part", F.col("half.mask").alias("mask")).agg(
        F.sum("half.n").alias("n"), weighed("is_good").alias("good"), weighed("is_toxic").alias("toxic")).filter("n > 0")


def removal_steps(fails: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Step (1-based) at which each mask goes in each order: min-plus product of masks x filters and filters x orders.

    A mask that fails nothing gets one step more than there are filters."""
    never = places.shape[1] + 1
    cost = np.where(fails, 0, never)
    return np.minimum((cost[:, None, :] + places[None]).min(2), never)


def audited(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, good, toxic)."""
    k = len(filters)
    orders = np.array(list(permutations(range(k))))
    places = np.argsort(orders, 1) + 1  # the inverse permutation
    names = ["".join(filters[i] for i in order) for order in orders]

    def audit(frame: pd.DataFrame) -> pd.DataFrame:
        fails = (frame["mask"].to_numpy()[:, None] >> np.arange(k) & 1).astype(bool)
        steps, at = removal_steps(fails, places), np.arange(len(orders))
        n = frame["n"].to_numpy(np.int64)

        def scattered(weight: np.ndarray) -> np.ndarray:
            out = np.zeros((len(orders), k + 2), np.int64)
            np.add.at(out, (at[None], steps), weight[:, None])
            return out[:, 1: k + 1]

        def by_step(per_filter: np.ndarray) -> np.ndarray:
            return np.take_along_axis(np.broadcast_to(per_filter, orders.shape), orders, 1)

        removed = scattered(n)
        earlier = np.einsum("m,mok->ok", n, (fails[:, None, :] & (steps[:, :, None] < places[None])).astype(np.int64))
        alone = (n[:, None] * (fails & (fails.sum(1) == 1)[:, None])).sum(0)
        shapley = np.take_along_axis(removed, places - 1, 1).sum(0)
        return pd.DataFrame({
            "part": frame["part"].iloc[0], "filter_order": np.repeat(names, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
            "filter": np.array(list(filters), object)[orders].ravel(), "kept": (n.sum() - removed.cumsum(1)).ravel(), "removed": removed.ravel(),
            "redundant": by_step(earlier).ravel(), "unique_fails": by_step(alone).ravel(),
            "good_lost": scattered(frame["good"].to_numpy(np.int64)).ravel(),
            "toxic_lost": scattered(frame["toxic"].to_numpy(np.int64)).ravel(), "shapley": by_step(shapley).ravel()})

    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in COUNTS)
    return counts.groupBy("part").applyInPandas(audit, schema)
