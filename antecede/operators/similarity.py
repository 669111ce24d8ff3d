"""Near-duplicate texts, BM25 scores and vector similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from antecede.functions.words import question_tokens, stripped
from antecede.operators.components import connected_components, label_all
from antecede.session import checkpointed

SHINGLE = 5
NEAR_DUPLICATE = 0.8
BM25_K1, BM25_B = 1.2, 0.75
TILE_ROWS = 2048
ASKED = 1 << 20  # terms of all questions that every task may hold
POSTINGS = 1 << 20  # questions of a batch's postings that a task adds up at once
OFTEN, COMMON = 16, 1 << 18  # sets that begin with a common shingle, and how many of these are told apart


def word_list(text: Column) -> Column:
    return F.split(stripped(text), r"\s+")


def shingle_hashes(words: str, size: int = SHINGLE) -> Column:
    """Distinct hashes of the word ``size``-grams of texts with at least ``size`` words.

    ``words`` names a column: an expression would be computed again for every gram."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.array_join(F.slice(words, i + 1, F.lit(size)), " "))))


def exact_links(records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(a, b) joining each record to the first one with the same value of a field.

    A star per value, so a value held by a third of all rows adds one edge per row."""
    links = None
    for field in fields:
        known = records.filter(F.col(field).isNotNull() & (F.col(field) != "")).select(key, field)
        lead = known.groupBy(field).agg(F.min(key).alias("a"))
        part = known.join(lead, field).select("a", F.col(key).alias("b")).filter("a <> b")
        links = part if links is None else links.unionByName(part)
    return links


def _reach(size: Column, threshold: float) -> Column:
    """How many shingles of a set, in one order of all shingles, are sure to hold one of any set as alike as ``threshold``."""
    # Guard the ceiling against binary noise: 0.8 * 5 must stay 4.
    return size - F.ceil(F.round(F.lit(threshold) * size, 6)) + 1


def _common(sets: DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sets begin with, ascending, and how many do: the ``COMMON`` commonest at most."""
    first = F.slice("shingles", F.lit(1), _reach(F.col("size"), threshold).cast("int"))
    held = sets.select(F.explode(first).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    rows = held.orderBy(F.desc("n"), "h").limit(COMMON).toPandas().sort_values("h")
    return rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, id, size, first): each set's first shingles, those that several sets begin with, and the first set of each.

    Two sets as alike as ``threshold`` share one of them, whatever order all sets use. Here the order is by hash, with the
    common shingles last by number; so shingles are neither counted nor sorted by shuffling all of them."""
    common, number = _common(sets, threshold)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                h, size = batch.column("shingles").flatten().to_numpy(), batch.column("size").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                if len(common):
                    place = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    order = np.lexsort((np.where(common[place] == h, number[place], 0), row))  # by hash already
                else:
                    order = np.arange(len(h))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                reach = size - np.ceil(np.round(threshold * size, 6)).astype(np.int64) + 1
                taken = order[rank < reach[row]]
                of = pa.array(row[taken])
                yield pa.RecordBatch.from_arrays([pa.array(h[taken]), batch.column("id").take(of), batch.column("size").take(of)],
                                                 names=["h", "id", "size"])

    schema = StructType([StructField("h", LongType()), sets.schema["id"], sets.schema["size"]])
    each = sets.select("id", "size", "shingles").mapInArrow(begin, schema)
    same = Window.partitionBy("h")
    return each.withColumns({"n": F.count("*").over(same), "first": F.min(F.struct("id", "size")).over(same)}).filter("n > 1").drop("n")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs whose shingle sets are as alike as the threshold."""
    pairs = checkpointed(pairs)
    # Only sets of a pair move; the pairs' table is small enough to broadcast unless copies are very many.
    side = lambda n: sets.join(pairs.select(F.col(n).alias("id")), "id", "left_semi").select(
        F.col("id").alias(n), F.col("shingles").alias(f"s{n}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.size("sa") + F.size("sb") - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(alike >= threshold).select("a", "b")


def near_duplicate_links(records: DataFrame, key: str, text: str,
                         threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """(a, b) links whose components are exactly those of all pairs at the threshold.

    Records with equal shingle sets hang on their first one. The rest are compared in two
    rounds over shared rare shingles. Round one compares each set with the first set of its
    shingle, which links the bulk of a large group of near copies. Round two compares only
    sets still in different components, since no further link inside one could matter, and
    of those only pairs that share enough of their rare shingles to be able to link."""
    # Short texts leave by their word count: a filter on the shingles would be pushed below
    # the projection and compute them twice.
    shingled = checkpointed(
        records.select(F.col(key).alias("id"), word_list(F.col(text)).alias("words"))
        .filter(F.size("words") >= SHINGLE)
        .select("id", F.array_sort(shingle_hashes("words")).alias("shingles"))
        .withColumn("size", F.size("shingles"))
        .withColumn("digest", F.sha2(F.array_join("shingles", ","), 256)))
    leads = shingled.groupBy("digest").agg(F.min("id").alias("a"))
    copies = checkpointed(shingled.select("id", "digest").join(leads, "digest").filter("a <> id").select("a", F.col("id").alias("b")))
    sets = shingled.join(copies.select(F.col("b").alias("id")), "id", "left_anti").select("id", "size", "shingles")
    prefixes = checkpointed(_prefixes(sets, threshold))
    fits = (F.col("size") >= F.lit(threshold) * F.col("size2")) & (
        F.col("size2") >= F.lit(threshold) * F.col("size"))

    starred = prefixes.select("id", "size", F.col("first.id").alias("a"), F.col("first.size").alias("size2")).filter(
        F.col("id") != F.col("a")).filter(fits).select("a", F.col("id").alias("b")).distinct()
    star_links = checkpointed(_verified(starred, sets, threshold))

    placed = checkpointed(label_all(prefixes.drop("first"), connected_components(star_links), "id"))
    # Shingles whose sets are all in one component already have nothing left to link.
    open_shingles = placed.groupBy("h").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h")
    left = placed.join(open_shingles, "h", "left_semi")
    other = left.select("h", F.col("id").alias("b"), F.col("size").alias("size2"),
                        F.col("component").alias("component2"))
    # All that two sets share up to where one's first shingles end is among the shingles met; the rest of that one is what else can be shared.
    met = left.join(other, "h").filter("component <> component2 AND id < b").filter(fits).groupBy(
        F.col("id").alias("a"), "b", "size", "size2").agg(F.count("*").alias("met"))
    rest = lambda c: F.col(c) - _reach(F.col(c), threshold)
    needed = (F.col("size") + F.col("size2")) * (threshold / (1 + threshold)) - 1e-6
    across = met.filter(F.col("met") + F.greatest(rest("size"), rest("size2")) >= needed).select("a", "b")
    return copies.unionByName(star_links).unionByName(_verified(across, sets, threshold))


def duplicate_groups(records: DataFrame, key: str, text: str,
                     exact_fields: Sequence[str]) -> DataFrame:
    """(key, component): records that must stay together."""
    links = near_duplicate_links(records, key, text)
    if exact_fields:
        links = links.unionByName(exact_links(records, key, exact_fields))
    return label_all(records.select(key), connected_components(links), key)


def bm25_scores(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, node, score) for every node sharing a term with the question.

    ``docs`` has (node, text); ``questions`` has (question_id, question). Only the postings
    of question terms are ever joined. Texts are tokenised once, into a stored table. A text that many nodes hold may stand
    once, with their number in ``copies``; its score is that of each of them."""
    copies = F.col("copies") if "copies" in docs.columns else F.lit(1)
    tokens = checkpointed(docs.select("node", copies.cast("long").alias("copies"), question_tokens(F.col("text")).alias("tokens")))
    asked = checkpointed(questions.select("question_id", F.explode(F.array_distinct(question_tokens(F.col("question")))).alias("term")))
    repeated = tokens.groupBy("node").count().filter("count > 1")
    if asked.limit(ASKED + 1).count() > ASKED or not repeated.isEmpty():
        return _joined_scores(tokens, asked)
    return _scores_in_place(tokens, asked)


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _totals(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.sum("copies").alias("n"), (F.sum(F.size("tokens") * F.col("copies")) / F.sum("copies")).alias("avg_len"))


def _scores_in_place(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores of nodes that stand once: each is scored where its tokens lie, so no task holds more than a batch, however many
    nodes there are. The asked terms, ``ASKED`` of all questions together at most, go to every task."""
    n, avg_len = _totals(tokens).first()
    df = tokens.select("copies", F.explode(F.array_distinct("tokens")).alias("term")).join(
        F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("copies").alias("df"))
    held = asked.join(df.select("term", _idf(F.lit(n), F.col("df")).alias("idf")), "term").orderBy("term", "question_id").toArrow()
    question = held.column("question_id").combine_chunks().dictionary_encode(null_encoding="encode")
    term = held.column("term").combine_chunks().dictionary_encode()
    idf, code = held.column("idf").to_numpy(), term.indices.to_numpy()
    terms, start = term.dictionary, np.searchsorted(code, np.arange(len(term.dictionary) + 1))
    questions, asked_by = question.dictionary, question.indices.to_numpy().astype(np.int64)
    schema = StructType([asked.schema["question_id"], tokens.schema["node"], StructField("score", DoubleType())])
    k1, b, most = BM25_K1, BM25_B, POSTINGS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            length = np.diff(lists.offsets.to_numpy())
            at = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(len(length)), length)[at >= 0]
            key, tf = np.unique(row * max(len(terms), 1) + at[at >= 0], return_counts=True)
            row, at = np.divmod(key, max(len(terms), 1))
            damp = k1 * (1 - b + b * length[row] / avg_len) if len(row) else tf
            weight = idf[start[at]] * tf * (k1 + 1) / (tf + damp)
            width = start[at + 1] - start[at]
            done = np.cumsum(width)  # questions met up to each posting
            ends = np.flatnonzero(np.diff(row, append=-1)) + 1  # a node's postings stay together
            first = 0
            while first < len(row):
                base = done[first - 1] if first else 0
                fit = ends[(ends > first) & (done[ends - 1] - base <= most)]
                last = fit[-1] if len(fit) else ends[ends > first][0]
                w = width[first:last]
                place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[at[first:last]], w)
                pair, of = np.unique(np.repeat(row[first:last], w) * len(questions) + asked_by[place], return_inverse=True)
                total = np.bincount(of, np.repeat(weight[first:last], w))
                node, q = np.divmod(pair, len(questions))
                yield pa.RecordBatch.from_arrays([questions.take(pa.array(q)), batch.column("node").take(pa.array(node)), pa.array(total)],
                                                 names=["question_id", "node", "score"])
                first = last

    found = tokens.select("node", "tokens").mapInArrow(score, schema)
    return found.withColumn("score", F.round("score", 6)).filter("score > 0")


def _joined_scores(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores where a node has several rows, or more terms are asked than every task can hold."""
    totals = _totals(tokens)
    n, avg_len = totals.select("n").scalar(), totals.select("avg_len").scalar()
    postings = (
        tokens.select("node", "copies", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("term", "node", "copies", "length").agg(F.count("*").alias("tf"))
    )
    df = postings.groupBy("term").agg(F.sum("copies").alias("df"))
    idf = _idf(n, F.col("df"))
    damp = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / avg_len)
    weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + damp)
    weighted = postings.join(df, "term").select("term", "node", weight.alias("w"))
    return asked.join(weighted, "term").groupBy("question_id", "node").agg(
        F.round(F.sum("w"), 6).alias("score")).filter("score > 0")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def max_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The best cosine between the unit vectors of each pair's two sets.

    ``pairs`` has (a, b); ``vectors`` has (owner, vector)."""
    side = lambda n: vectors.select(F.col("owner").alias(n), F.col("vector").alias(f"v{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").groupBy("a", "b").agg(
        F.max(dot(F.col("va"), F.col("vb"))).alias("similarity"))


def cosine_join(left: DataFrame, right: DataFrame, floor: float | Callable[[str], float]) -> DataFrame:
    """(block, a, b, similarity) for left and right rows of a block at or above ``floor``, which may depend on the block.

    Both sides have (block, id, vector) with unit vectors. Each side of a block is cut into
    tiles of about TILE_ROWS rows and each pair of tiles is one small matrix product, so a hot
    block spreads over many tasks and only pairs at the floor leave a task."""
    def tiled(side: DataFrame, other: DataFrame, own: str, opposite: str) -> DataFrame:
        tiles = lambda df, name: df.groupBy("block").agg(
            F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("int").alias(name))
        placed = side.join(tiles(side, "n_own"), "block").join(tiles(other, "n_other"), "block")
        return placed.select(
            F.col("block").alias("block"), F.col("id").alias("id"), F.col("vector").alias("vector"),
            F.pmod(F.xxhash64("id"), F.col("n_own")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias(opposite))

    def multiply(key: tuple, rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or columns.empty:
            return pd.DataFrame({"block": [], "a": [], "b": [], "similarity": []})
        x, y = (np.stack(d["vector"].to_numpy()).astype(np.float64) for d in (rows, columns))
        products = x @ y.T
        at = np.argwhere(products >= (floor(key[0]) if callable(floor) else floor))
        return pd.DataFrame({
            "block": key[0], "a": rows["id"].to_numpy()[at[:, 0]],
            "b": columns["id"].to_numpy()[at[:, 1]], "similarity": products[at[:, 0], at[:, 1]]})

    types = {c: left.schema[c].dataType.simpleString() for c in ("block", "id")}
    grid = ["block", "i", "j"]
    return tiled(left, right, "i", "j").groupBy(*grid).cogroup(
        tiled(right, left, "j", "i").groupBy(*grid)
    ).applyInPandas(multiply, f"block {types['block']}, a {types['id']}, b {types['id']}, similarity double")


def cosine_pairs(vectors: DataFrame, floor: float) -> DataFrame:
    """(block, a, b, similarity) for every pair a < b of a block at or above ``floor``."""
    return cosine_join(vectors, vectors, floor).filter("a < b")
