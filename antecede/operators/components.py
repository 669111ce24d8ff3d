"""Weakly connected components, labelled by their smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from antecede.session import checkpointed, discard

HELD = 1 << 20  # edges a task holds to thin them


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Point each node's larger neighbours at the smallest node around it."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
        edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    smallest = both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.filter("w > n").join(smallest, "n").select(
        F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point each node and its smaller neighbours at the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").filter("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another node.

    Star contraction: a component of n nodes settles in O(log^2 n) rounds, and each round
    moves at most two rows per edge, so one huge component costs no more than many small ones. A round's table goes
    when the next one is written."""
    stars = checkpointed(edges.select(
        F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    ).filter("u <> v").distinct())
    seen = _fingerprint(stars)
    while True:
        spent, stars = stars, checkpointed(_small_star(_large_star(stars)))
        now = _fingerprint(stars)
        discard(spent)
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = now


def thinned(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(first, second): fewer edges with the same components. A task holds ``HELD`` edges at most and leaves out those that
    close a circle among them, so many edges between few nodes shrink before they are first written."""
    def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same components with an edge per node: each to the smallest of its own."""
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = place[:len(u)], place[len(u):]
        label = np.arange(len(nodes))
        while (apart := label[a] != label[b]).any():
            a, b = label[a[apart]], label[b[apart]]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        moved = label != np.arange(len(nodes))
        return nodes[moved], nodes[label[moved]]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, kept = [], 0, 0
        for batch in batches:
            held.append((batch[first].to_numpy(), batch[second].to_numpy()))
            size += len(batch)
            if size - kept >= HELD // 2:
                held = [stars(*(np.concatenate(side) for side in zip(*held)))]
                size = kept = len(held[0][0])
                if kept > HELD // 2:
                    yield pd.DataFrame({first: held[0][0], second: held[0][1]})
                    held, size, kept = [], 0, 0
        if size:
            rest = stars(*(np.concatenate(side) for side in zip(*held)))
            yield pd.DataFrame({first: rest[0], second: rest[1]})

    pairs = edges.filter(F.col(first) != F.col(second)).select(first, second)
    return pairs.mapInPandas(thin, pairs.schema)


def label_all(nodes: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    return nodes.join(components.withColumnRenamed("node", key), key, "left").withColumn(
        "component", F.coalesce("component", key))
