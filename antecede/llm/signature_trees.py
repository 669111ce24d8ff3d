"""N-gram Jaccard join with signature trees.

A document's set is its distinct word shingles. Equal sets collapse to one representative. Two sets
can only reach the threshold when they share a token among the first ones of a common order (the
prefix), so documents are dealt into families by shared prefix tokens. A family's members are
arranged in signature trees: a node holds the OR of its members' token bitmaps and their range of
sizes. Two trees are traversed together, and a pair of nodes is dropped when the largest overlap that
bitmaps and sizes allow is below what the threshold needs, or when all their members are in one class already.

Families are traversed twice. First over stored bitmaps of about eight bits a token: pairs that these do not rule
out, directly or in steps, form narrower families. In these, texts travel, each once, and leaves are compared
exactly, token by token. Either way only links that join two classes leave a task, at most one fewer than it has
documents, never all pairs.

The common order puts tokens that many documents hold last. How often is read from a table of
``SKETCH`` counters, a bound on what is broadcast; a counter shared by chance only changes the order, never
a result. Families above ``BLOCK`` members are cut into blocks by size, and by hash of the id where a size alone has so many; pairs of
blocks are tasks of their own, after a look at sizes and classes of the blocks and of each member that would travel.

Shared prefix tokens give a family per document and token; a token's family is the smallest of its
members' home families (the token of theirs that most documents share), so that a group of copies
meets in one family and not once per token, while every pair that shares a token still meets.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; fewer
words than a shingle make one shingle of all; rows repeating a set are linked (with empty sets: not); rows
that share an id, or have none, are linked by their texts only; a null id sorts first as a class; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import WordHashes, joined_small, mixed, rolled, small_batches, stored
from antecede.operators.components import connected_components

SKETCH, SLICES, SHARDS = 1 << 20, 16, 256
BUCKET = np.uint64(64 - 20)  # shift from a token to its counter
HOT_DEVIATIONS, HOT_LEAST = 6, 32  # a counter this far above the mean marks frequent tokens
BLOCK = 2048
LEAF = 16
MAX_BYTES = 1024  # of a bitmap that travels; eight bits a token up to there
NO_ID = -(1 << 63)


def tokens(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, with A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(hashes.fresh().of(words), width))


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of n and m that reaches the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def _sketched(docs: DataFrame, width: int) -> np.ndarray:
    """Level of each counter: 0 where its tokens are ordinary, else the logarithm of the count.

    Each task sends its counters as ``SLICES`` rows of bytes, which are added up in two rounds, so that no
    sum reads more than a share of the tasks.
    """
    slice_size = SKETCH // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = WordHashes(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, (tokens(text, hashes, width) >> BUCKET).astype(np.int64), 1)
        if total.any():
            shard = TaskContext.get().partitionId() % SHARDS
            yield pd.DataFrame({"at": np.arange(SLICES), "shard": shard, "counts": [
                total[i * slice_size: (i + 1) * slice_size].tobytes() for i in range(SLICES)]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(slice_size, np.int64)
        for part in frame["counts"]:
            total += np.frombuffer(part, np.int64)
        return pd.DataFrame({"at": [frame["at"].iloc[0]], "shard": [0], "counts": [total.tobytes()]})

    schema = "at long, shard long, counts binary"
    rows = docs.select("text").mapInPandas(count, schema)
    sums = rows.groupBy("at", "shard").applyInPandas(add, schema).groupBy("at").applyInPandas(add, schema)
    counts = np.zeros(SKETCH, np.int64)
    for row in sums.collect():  # SKETCH counters, whatever the input
        counts[row.at * slice_size: (row.at + 1) * slice_size] = np.frombuffer(row.counts, np.int64)
    mean = counts.mean()
    hot = counts > mean + HOT_DEVIATIONS * np.sqrt(mean) + HOT_LEAST
    return np.where(hot, np.log2(np.maximum(counts, 1)), 0).astype(np.uint8)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, doc_id, n, d1, d2, prefix, bits): size, digests, prefix tokens and token bitmap of every document's set."""
    levels = docs.sparkSession.sparkContext.broadcast(_sketched(docs, width))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, level = WordHashes(), levels.value
        for batch in batches:
            n, d1, d2, prefixes, bits = [], [], [], [], []
            for text in batch["text"]:
                found = tokens(text, hashes, width)
                n.append(len(found))
                d1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                size = len(found) - -(-percent * len(found) // 100) + 1 if len(found) else 0
                order = np.argsort(level[(found >> BUCKET).astype(np.int64)], kind="stable")[:size]
                prefixes.append(found[order].view(np.int64))
                n_bits = 8 * (min(MAX_BYTES, max(8, 1 << (len(found) - 1).bit_length())) if len(found) else 8)
                flags = np.zeros(n_bits, bool)
                flags[(found & np.uint64(n_bits - 1)).astype(np.int64)] = True
                bits.append(np.packbits(flags, bitorder="little").tobytes())
            yield pd.DataFrame({"id": batch["id"], "doc_id": batch["doc_id"], "n": n, "d1": d1, "d2": d2, "prefix": prefixes, "bits": bits})

    return docs.select("id", "doc_id", "text").mapInPandas(
        describe, "id long, doc_id long, n long, d1 long, d2 long, prefix array<long>, bits binary")


def _families(prefixes: DataFrame) -> DataFrame:
    """(family, id): documents that share a prefix token meet in at least one family."""
    rows = prefixes.select("id", F.explode_outer("prefix").alias("token")).filter("token is not null").repartition("token")
    shared = rows.join(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "token")
    shared = stored(shared, "shared_tokens")
    home = shared.groupBy("id").agg(F.max(F.struct("c", "token"))["token"].alias("home"))
    homed = shared.select("id", "token").join(home, "id")
    family = homed.groupBy("token").agg(F.min("home").alias("family"))
    return homed.select("id", "token").join(family, "token").select("family", "id").distinct()


def _sized(families: DataFrame, percent: int) -> DataFrame:
    """Members that have another one of a size they can reach the threshold with.

    Sizes are dealt into bands of that ratio: a partner lies in the same band or the next one."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    banded = families.withColumn("band", band)
    filled = banded.groupBy("family", "band").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    near = lambda step: filled.select("family", (F.col("band") - step).alias("band"), *[
        F.col(c).alias(f"{c}{step + 1}") for c in ("low", "high")])
    fits = lambda a, b: F.coalesce(100 * F.col(a) >= percent * F.col(b), F.lit(False))
    around = filled.join(near(1), ["family", "band"], "left").join(near(-1), ["family", "band"], "left")
    return banded.join(around, ["family", "band"]).filter(
        (F.col("c") > 1) | fits("n", "low2") | fits("high0", "n")).select("family", "id", "n")


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(out[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


class Classes:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def all(self) -> np.ndarray:
        while not np.array_equal(self.up, self.up[self.up]):
            self.up = self.up[self.up]
        return self.up


class Tree:
    """Levels of nodes over ordered sets; level 0 are the sets.

    A node has the OR of its bitmaps, its smallest and largest size, and its slack: the most tokens of a
    member that share a bit with another token of that member.
    """

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(maps), LEAF)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts), np.maximum.reduceat(slack, cuts)))


def _possible(a: tuple, b: tuple, pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a linked pair, by sizes and by what their bitmaps can share."""
    (maps_a, low_a, high_a, slack_a), (maps_b, low_b, high_b, slack_b) = a, b
    i, j = pairs[:, 0], pairs[:, 1]
    keep = np.flatnonzero((100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i]))
    i, j = i[keep], j[keep]
    shared = np.bitwise_count(maps_a[i] & maps_b[j]).sum(1, dtype=np.int64)
    # A member's tokens on the shared bits are as many as these bits, and its slack more at most.
    most = np.minimum(np.minimum(high_a[i], high_b[j]), shared + np.minimum(slack_a[i], slack_b[j]))
    return keep[most >= _needed(low_a[i], low_b[j], percent)]


def _dual(a: Tree, b: Tree, same: bool, labels: Callable[[], np.ndarray], percent: int,
          meet: Callable[[int, int], None]) -> None:
    """Call ``meet`` for the pairs of members that may be linked and lie in different classes.

    ``labels`` gives the classes now, members of ``a`` first; ``same``: both trees are one."""
    shift = 0 if same else len(a.levels[0][0])
    level = lambda t, k: min(k, len(t.levels) - 1)
    children = lambda t, k, i: (np.arange(i * LEAF, min((i + 1) * LEAF, len(t.levels[k - 1][0])))
                                if level(t, k) == k else np.array([i]))
    frontier = [(max(len(a.levels), len(b.levels)) - 1, np.zeros((1, 2), np.int64))]
    while frontier:
        k, pairs = frontier.pop()
        pairs = pairs[_possible(a.levels[level(a, k)], b.levels[level(b, k)], pairs, percent)]
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        if k == 0:
            for i, j in pairs.tolist():
                if not same or i < j:
                    meet(i, j + shift)
            continue
        for lo in range(0, len(pairs), 64):
            down, label = [], labels()
            for i, j in pairs[lo: lo + 64].tolist():
                ci, cj = children(a, k, i), children(b, k, j)
                grid = np.stack([np.repeat(ci, len(cj)), np.tile(cj, len(ci))], 1)
                down.append(grid if k > 1 else grid[label[grid[:, 0]] != label[grid[:, 1] + shift]])
            frontier.append((k - 1, np.concatenate(down)))


class Exact:
    """Compares sets token by token; a linked pair joins two classes."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent
        self.hashes = WordHashes()

    def loaded(self, frame: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
        """Ids and sets, ordered so that like sets are neighbours: by size band, then smallest tokens."""
        sets, ids = [tokens(t, self.hashes, self.width) for t in frame["text"]], frame["id"].tolist()
        order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (
            int(np.log2(len(sets[i])) * 4), tuple(sets[i][:4].tolist()), i))
        return [ids[i] for i in order], [sets[i] for i in order]

    def links(self, left: list[np.ndarray], right: list[np.ndarray] | None, classes: Classes) -> list[tuple[int, int]]:
        """Positions of linked pairs that join two classes; those of ``right`` follow those of ``left``."""
        both, found = left + (right or []), []
        bits = 1 << max(6, min(15, int(np.ceil(np.log2(8 * max(map(len, both)) + 1)))))
        tree = lambda sets: Tree(_bitmaps(sets, bits), np.array([len(s) for s in sets]))
        a = tree(left)

        def meet(i: int, j: int) -> None:
            if classes.find(i) != classes.find(j):
                x, y = both[i], both[j]
                n = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * n >= self.percent * (len(x) + len(y) - n):
                    classes.join(i, j)
                    found.append((i, j))

        _dual(a, a if right is None else tree(right), right is None, classes.all, self.percent, meet)
        return found


class Likely:
    """Compares bitmaps only; a pair that may be linked joins two classes. No linked pair is missed."""

    def __init__(self, percent: int):
        self.percent = percent

    def loaded(self, frame: pd.DataFrame) -> tuple[list[int], list[tuple[int, bytes]]]:
        rows = sorted(zip(frame["n"].tolist(), frame["bits"].tolist(), frame["id"].tolist()), key=lambda r: (
            int(np.log2(r[0]) * 4), r[1][:16], r[2]))
        return [r[2] for r in rows], [(r[0], r[1]) for r in rows]

    def links(self, left: list[tuple[int, bytes]], right: list[tuple[int, bytes]] | None, classes: Classes) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        sides = [(left, 0)] if right is None else [(left, 0), (right, len(left))]
        groups = []  # of one bitmap width on one side: positions, maps, sizes
        for rows, shift in sides:
            by_width: dict[int, list[int]] = {}
            for i, (_, bits) in enumerate(rows):
                by_width.setdefault(len(bits), []).append(i)
            groups.append({w: (np.array(at) + shift, np.stack([np.frombuffer(rows[i][1], np.uint64) for i in at]),
                               np.array([rows[i][0] for i in at])) for w, at in by_width.items()})
        for w, (at, maps, size) in groups[0].items():
            for v, (other, maps2, size2) in groups[-1].items():
                # Linked sets differ in size by less than half: their widths are equal or neighbours.
                if max(w, v) > 2 * min(w, v) or (right is None and v < w):
                    continue
                narrow = min(w, v) // 8
                folded = [m if m.shape[1] == narrow else m[:, :narrow] | m[:, narrow:] for m in (maps, maps2)]
                same = right is None and v == w
                place = at if same else np.concatenate([at, other])

                def meet(i: int, j: int, place: np.ndarray = place) -> None:
                    if classes.join(int(place[i]), int(place[j])):
                        found.append((int(place[i]), int(place[j])))

                a = Tree(folded[0], size)
                _dual(a, a if same else Tree(folded[1], size2), same, lambda place=place: classes.all()[place], self.percent, meet)
        return found


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a task's sorted rows; a group has at most about BLOCK documents a side."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        keys = batch[by].to_numpy(np.int64)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
        if held and len(keys) and (held[-1][by].to_numpy(np.int64)[-1] != keys[0]).any():
            yield pd.concat(held)
            held = []
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
            held.append(batch.iloc[lo:hi])
            if hi < len(batch):
                yield pd.concat(held)
                held = []
    if held:
        yield pd.concat(held)


def _links(families: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of linked representatives.

    Bitmaps of all families come first. Documents that they may link, directly or in steps, are then compared
    exactly as one family, so each text travels once."""
    likely = _compared(families, sets.select("id", "bits", "n"), lambda: Likely(percent), percent, "likely")
    group = connected_components(likely).select(F.col("component").alias("family"), F.col("node").alias("id"))
    sized = group.join(sets.select("id", "n"), "id")
    return _compared(sized, docs.select("id", "text"), lambda: Exact(width, percent), percent, "exact")


def _compared(families: DataFrame, content: DataFrame, method: Callable, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) that ``method`` links in families (family, id, n): within each block, then between blocks whose
    sizes and classes allow it. ``content`` has by id what the method compares."""
    families = _sized(families.select("family", "id", "n"), percent)
    sizes = families.groupBy("family").agg(F.count("*").alias("c"))
    placed = families.join(sizes.filter("c > 1"), "family").withColumn("band", F.when(F.col("c") <= BLOCK, -1).otherwise(
        F.floor(F.log2(F.col("n").cast("double")) * 4)).cast("int"))
    # A large family is cut into bands of like sizes, and a band of more than a block by hash of the id.
    parts = placed.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = placed.join(parts, ["family", "band"]).withColumn("block", F.col("band").cast("long") * (1 << 32) + F.pmod(
        F.xxhash64("id"), F.col("parts")))
    schema = "a long, b long"

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = method()
        for frame in _groups(batches, ["family", "block"]):
            ids, rows = tool.loaded(frame)
            if len(ids) > 1 and (found := tool.links(rows, None, Classes(len(ids)))):
                yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"])

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = method()
        for frame in _groups(batches, ["family", "left", "right"]):
            (ids, a), (ids_b, b) = (tool.loaded(frame[frame["side"] == side]) for side in (0, 1))
            if not a or not b:
                continue
            ids, label = ids + ids_b, dict(zip(frame["id"], frame["label"]))
            known, first = Classes(len(ids)), {}
            for i, id_ in enumerate(ids):
                known.join(first.setdefault(label[id_], i), i)
            if found := tool.links(a, b, known):
                yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"])

    placed = stored(placed.select("family", "block", "band", "n", "id"), f"{name}_blocks")
    grouped = placed.select("family", "block", "id").join(content, "id").repartition("family", "block").sortWithinPartitions(
        "family", "block")
    inner = stored(grouped.mapInPandas(within, schema), f"{name}_inner")
    large = placed.filter("band >= 0")
    if large.isEmpty():
        return inner
    found = connected_components(inner)
    labelled = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("component", "id"))
    nodes = labelled.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                                    F.min("label").alias("l0"), F.max("label").alias("l1"))
    x, y = nodes.alias("x"), nodes.alias("y")
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") < F.col("y.block"))
                   & (F.col("y.high") * 100 >= F.col("x.low") * percent) & (F.col("x.high") * 100 >= F.col("y.low") * percent)
                   & ~((F.col("x.l0") == F.col("x.l1")) & (F.col("y.l0") == F.col("y.l1")) & (F.col("x.l0") == F.col("y.l0")))
                   ).select(F.col("x.family").alias("family"), F.col("x.block").alias("left"), F.col("y.block").alias("right"),
                            *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("low", "high", "l0", "l1")])
    # A block's members travel where the other block has a size they can be linked with and a class that is not theirs.
    side = lambda own, other, number: pairs.select(
        "family", "left", "right", F.col(own).alias("block"), F.lit(number).alias("side"),
        *[F.col(f"{other}_{c}").alias(c) for c in ("low", "high", "l0", "l1")])
    sides = side("left", "y", 0).unionByName(side("right", "x", 1))
    work = sides.join(labelled.select("family", "block", "id", "label", "n"), ["family", "block"]).filter(
        (F.col("high") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("low") * percent)
        & ~((F.col("l0") == F.col("label")) & (F.col("l1") == F.col("label")))).select(
        "family", "left", "right", "side", "id", "label").join(content, "id")
    work = work.repartition("family", "left", "right").sortWithinPartitions("family", "left", "right")
    return inner.unionByName(stored(work.mapInPandas(between, schema), f"{name}_outer"))


def row_key(docs: DataFrame) -> Column:
    """Key of a row: equal where id and text are, and different elsewhere.

    The id is the key as long as it tells texts apart; a hash of id and text is it for rows without
    an id, and for all rows when any id has two texts.
    """
    doc_id, hashed = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text")
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = docs.filter("doc_id is not null").select(doc_id.alias("id"), th.alias("th")).groupBy("id").agg(
        F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo <> hi")
    return F.coalesce(doc_id, hashed) if shared.isEmpty() else hashed


def keyed_classes(docs: DataFrame, key: Column, width: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(id, doc_id, n_shingles, component) for every row, by row key; an absent doc_id is NO_ID.

    ``component`` is a key of the class, and the row's own where it is linked with nothing. ``known`` has links (a, b)
    between keys that hold whatever the texts are.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(key.alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    sets = stored(_sets(texts, width, percent), "sets")
    # One representative for each set; two digests and the size tell sets apart.
    heads = sets.filter("n > 0").groupBy("n", "d1", "d2").agg(
        F.min("id").alias("head"), F.count("*").alias("copies"), F.min_by("prefix", "id").alias("prefix"))
    families = stored(_families(heads.select(F.col("head").alias("id"), "prefix")), "families")
    sizes = heads.groupBy(F.col("head").alias("id")).agg(F.max("n").alias("n"))
    links = _links(families.join(sizes, "id"), sets.filter("n > 0"), texts, width, percent)
    copied = heads.filter("copies > 1").select("n", "d1", "d2", "head")
    copies = sets.select("id", "n", "d1", "d2").join(copied, ["n", "d1", "d2"]).filter("id <> head").select(
        F.col("id").alias("a"), F.col("head").alias("b"))
    links = links.unionByName(copies) if known is None else links.unionByName(copies).unionByName(known)
    found = connected_components(links)
    return sets.select("id", "doc_id", F.col("n").alias("n_shingles")).join(
        found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id reachable over links.

    Rows that repeat both id and text count as one document; no others are linked by their ids.
    """
    rows = stored(keyed_classes(docs, row_key(docs), width, percent), "class_rows")
    # Where the ids are the keys, a component is its smallest id already.
    named = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    smallest = rows.groupBy("component").agg(F.min(named).alias("low")).filter("low IS NULL OR low <> component")
    return joined_small(rows, smallest.withColumn("other", F.lit(True)), ["component"], "left").select(
        named.alias("doc_id"), "n_shingles", F.when(F.col("other"), F.col("low")).otherwise(F.col("component")).alias("component_id"))
