"""Merkle dataset manifest over blocks in van Emde Boas layout.

Leaves of a tree lie in order, and every ``FAN`` consecutive nodes (the last run: fewer, even one) become their parent
while a level has several. ``LEVELS`` levels at a time are one block: an aligned subtree over 4,096 leaves, held as one byte
string in van Emde Boas order, that is, split at half height into a top subtree and bottom subtrees, each stored
whole and split again. ``addresses`` is the arithmetic of this order, which serves construction and sibling retrieval
alike. The roots of a round's blocks are the leaves of the next round; a handful of rounds covers any input. The roots of the
trees are the leaves of one tree above them, made the same way.

Proofs come down the same rounds: what lies above a block is one list of siblings for all its leaves, joined to the block and never to
the leaves. A task holds one block and its leaves, whatever the size of a tree; a third of all rows in one tree is many blocks.
Texts are never shuffled, only ids and digests.

Defined results: leaves ascend by id, nulls first, then by leaf; equal leaves with equal ids may swap places; a null and an empty
tree name are different trees, null first; a tree of one leaf is that leaf; a lone leaf of a lone tree has an empty proof; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import joined_small, stored
from antecede.operators.ordering import with_position, with_running_total

FAN, LEVELS = 8, 4
DIGEST = 32
ABSENT = "-"
PATH = "lefts array<string>, rights array<string>"  # siblings left and right of the way up, lowest level first


class Manifest(NamedTuple):
    """``leaves``: (tree, at, doc_id, leaf, shown); ``rounds``: tables of blocks of the trees, lowest first; ``top``: those of the tree
    over their roots; ``trees``: (tree, name, present, n, first); ``levels`` of parents in a block."""

    leaves: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame
    levels: int


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: each value as its UTF-8 byte count, a colon and the value; ``-`` where it is null."""
    def field(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit(ABSENT))

    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def addresses(height: int) -> list[np.ndarray]:
    """Place of every node of a full tree of ``height`` levels, by depth and place in its level."""
    if height == 1:
        return [np.zeros(1, np.int64)]
    top = height // 2
    upper, lower = addresses(top), addresses(height - top)
    nodes = [(FAN ** h - 1) // (FAN - 1) for h in (top, height - top)]
    start = nodes[0] + np.arange(FAN ** top)[:, None] * nodes[1]  # of each bottom subtree
    return upper + [(start + within[None]).ravel() for within in lower]


LAYOUTS = {height: addresses(height) for height in range(1, LEVELS + 2)}


def _height(n: int, block: int, levels: int) -> int:
    """Levels of a block, leaves counted: all where the tree has other blocks, else those that lead to one root."""
    height = 1
    while height <= levels and (block > 0 or FAN ** (height - 1) < n):
        height += 1
    return height


def _level_hex(nodes: np.ndarray, height: int, depth: int, n: int) -> str:
    """Digests of the n first nodes of a level, in order, as one hex text."""
    return nodes[LAYOUTS[height][depth][:n]].tobytes().hex()


def built(leaves: bytes, block: int, levels: int = LEVELS) -> tuple[int, bytes]:
    """Height and bytes of the block over these digests, in van Emde Boas order."""
    n = len(leaves) // DIGEST
    height = _height(n, block, levels)
    layout = LAYOUTS[height]
    nodes = np.zeros((sum(map(len, layout)), DIGEST), np.uint8)
    nodes[layout[height - 1][:n]] = np.frombuffer(leaves, np.uint8).reshape(n, DIGEST)
    for depth in range(height - 1, 0, -1):
        text, run = _level_hex(nodes, height, depth, n), 2 * DIGEST * FAN
        parents = [sha256(text[i: i + run].encode()).digest() for i in range(0, len(text), run)]
        n = len(parents)
        nodes[layout[depth - 1][:n]] = np.frombuffer(b"".join(parents), np.uint8).reshape(n, DIGEST)
    return height, nodes.tobytes()


def siblings(data: bytes, height: int, n: int) -> list[tuple[list[str], list[str]]]:
    """For each of a block's n leaves the siblings left and right of its way to the block's root, lowest level first."""
    nodes, levels = np.frombuffer(data, np.uint8).reshape(-1, DIGEST), []
    for depth in range(height - 1, 0, -1):
        levels.append((_level_hex(nodes, height, depth, n), n))
        n = -(-n // FAN)
    width, out = 2 * DIGEST, []
    for at in range(levels[0][1] if levels else 1):
        lefts, rights = [], []
        for text, count in levels:
            first = at - at % FAN
            lefts.append(text[first * width: at * width])
            rights.append(text[(at + 1) * width: min(first + FAN, count) * width])
            at //= FAN
        out.append((lefts, rights))
    return out


def folded(leaf: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """Root that a leaf and the siblings of its way lead to, as hex."""
    for left, right in zip(lefts, rights):
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def _climbed(leaves: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Rounds of blocks (tree, at, leaf, height, n, nodes) over (tree, at, leaf): place and root of each, then its subtree."""
    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        digests = frame.sort_values("at")["leaf"].tolist()
        height, nodes = built(b"".join(digests), int(key[1]), levels)
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "leaf": [nodes[:DIGEST]], "height": [height], "n": [len(digests)], "nodes": [nodes]})

    rounds: list[DataFrame] = []
    while not rounds or not rounds[-1].filter("at > 0").isEmpty():
        below = (rounds[-1] if rounds else leaves).select("tree", "at", "leaf").withColumn("block", F.floor(F.col("at") / FAN ** levels))
        rounds.append(stored(below.groupBy("tree", "block").applyInPandas(
            build, "tree long, at long, leaf binary, height int, n int, nodes binary"), name))
    return rounds


def manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """Trees over (name, doc_id, leaf, shown), a tree for each name; ``shown`` is the digest that is later held against the proof."""
    rows = stored(leaves.select(F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNotNull().alias("present"),
                                "doc_id", "leaf", "shown", F.monotonically_increasing_id().alias("row")), "leaves")
    counts = rows.groupBy("name", "present").agg(F.count("*").alias("n"))
    trees = with_position(counts, [F.col("present"), F.col("name")], "tree")
    trees = stored(with_running_total(trees, [F.col("tree")], F.col("n"), "first").withColumn("tree", F.col("tree").cast("long") - 1), "trees")
    placed = with_position(joined_small(rows, trees.drop("n"), ["name", "present"]).drop("name", "present"),
                           [F.col(c) for c in ("tree", "doc_id", "leaf", "row")])
    placed = stored(placed.withColumn("at", F.col("position").cast("long") - 1 - F.col("first")).select("tree", "at", "doc_id", "leaf", "shown"), "placed")
    rounds = _climbed(placed, "blocks", levels)
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "leaf")
    return Manifest(placed, rounds, _climbed(subroots, "top", levels), trees, levels)


def _descended(rounds: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """(tree, at, path) of the lowest blocks' leaves, from (tree, path) of the trees' roots."""
    span = FAN ** levels

    def extend(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, at, height, n, nodes, lefts, rights in frame.itertuples(index=False, name=None):
            out += [(tree, at * span + i, [*a, *lefts], [*b, *rights]) for i, (a, b) in enumerate(siblings(nodes, height, n))]
        return pd.DataFrame(out, columns=["tree", "at", "lefts", "rights"])

    above = paths.select("tree", F.lit(0).cast("long").alias("at"), "lefts", "rights")
    for blocks in reversed(rounds):
        rows = blocks.select("tree", "at", "height", "n", "nodes").join(above, ["tree", "at"])
        above = stored(rows.mapInPandas(lambda frames: map(extend, frames), f"tree long, at long, {PATH}"), "paths")
    return above


def proved(made: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of every leaf; the last from its ``shown`` digest."""
    span = FAN ** made.levels
    none = F.array().cast("array<string>")
    top = _descended(made.top, made.top[-1].select("tree", none.alias("lefts"), none.alias("rights")), made.levels)
    tree_paths = top.select(F.col("at").alias("tree"), "lefts", "rights")
    blocks = made.rounds[0].join(_descended(made.rounds[1:], tree_paths, made.levels).select("tree", "at", "lefts", "rights"), ["tree", "at"])
    subroots = made.rounds[-1].select("tree", F.lower(F.hex("leaf")).alias("subroot"))
    blocks = joined_small(blocks.select("tree", F.col("at").alias("block"), "height", "n", "nodes", "lefts", "rights"), subroots, ["tree"])
    root = made.top[-1].select(F.lower(F.hex("leaf")).alias("root")).first()

    def prove(leaves: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        held = block.iloc[0]
        ways = siblings(held["nodes"], int(held["height"]), int(held["n"]))
        above, over = (list(held["lefts"]), list(held["rights"])), "".join(a + b for a, b in zip(held["lefts"], held["rights"]))
        out = []
        for at, doc_id, leaf, shown in zip(leaves["at"], leaves["doc_id"], leaves["leaf"], leaves["shown"]):
            lefts, rights = ways[at % span]
            proof = "".join(a + b for a, b in zip(lefts, rights)) + over
            out.append((doc_id, leaf.hex(), held["subroot"], sha256(proof.encode()).hexdigest(),
                        folded(shown.hex(), lefts + above[0], rights + above[1])))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]).astype({"doc_id": "Int64"})

    leaves = made.leaves.withColumn("block", F.floor(F.col("at") / span))
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(
        prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string").withColumn(
        "root", F.lit(root.root if root else None).cast("string"))
