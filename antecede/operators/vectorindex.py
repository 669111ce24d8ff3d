"""Exact pairs of similar unit vectors through a pivot index.

Vectors are dealt to the nearest of a bounded number of pivots and keep their angle to it. A pivot's vectors are cut into
tiles by day (where spans are given) or by that angle. The angle between two unit vectors is a metric, so two tiles cannot hold a pair
within ``limit`` when the angle between their pivots, less what the tiles reach, is larger, or when one tile lies further
from its pivot than the other and the pivots together can bridge. Tiles whose spans of days do not meet are
passed over too. Only the remaining pairs of tiles are multiplied, so nothing is lost at any floor; vectors without any
structure prune little by angle, which no exact index can help.

Between two tables equal vectors are one row of the index; pairs of their members are listed afterwards. Within one table every
row is in the index with what its pairs are judged by, so a pair leaves a task only when it is wanted and is never shuffled; a task
takes a square of up to ``SQUARE`` by ``SQUARE`` tiles, so a tile is sent once for many partners. Only the vectors that pivots are
chosen from and one row per pivot are collected: ``DRAWN * MAX_PIVOTS`` and ``MAX_PIVOTS``, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from antecede.operators.ordering import with_position
from antecede.session import checkpointed

TILE_ROWS = 2048
MAX_PIVOTS = 1024
DRAWN = 8
BANDS = 64  # of a pivot's rows by day or angle; larger ones are cut on by hash
SQUARE = 8  # tiles on a side of what one task multiplies
SQUARES = 16  # sides at least, before they grow, so that small tables spread over many tasks
CELLS = 1 << 21  # products that a task holds at once
OUT_ROWS = 1 << 17  # pairs in a batch that leaves a task
SLACK = 2e-3  # radians that rounding of single-precision vectors may move an angle


class VectorIndex(NamedTuple):
    """``members`` (id, head), ``rows`` (tile, head, vector, what else the heads hold), ``tiles`` (tile, cluster, low, high, first, last, n)."""

    members: DataFrame
    rows: DataFrame
    tiles: DataFrame


def _heads(rows: DataFrame) -> DataFrame:
    """(vector, head, first, last): one row per distinct vector, with the days of all its members."""
    day = lambda c: F.col(c) if c in rows.columns else F.lit(0)
    return checkpointed(rows.filter("vector is not null").select("id", "vector", day("first").alias("first"), day("last").alias("last")).groupBy(
        "vector").agg(F.min("id").alias("head"), F.min("first").alias("first"), F.max("last").alias("last")))


def _matrix() -> Callable[[pa.Array], np.ndarray]:
    """Vectors of one length as rows, in double precision; made anew, so that it travels to workers without this module."""
    return lambda vectors: vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def chosen_pivots(heads: DataFrame) -> np.ndarray:
    """About one per tile of rows: of ``DRAWN`` times as many that come first by hash, each the one farthest from those before."""
    wanted = min(MAX_PIVOTS, -(-heads.count() // TILE_ROWS))
    rows = heads.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(DRAWN * wanted).collect()
    drawn = np.array([r.vector for r in rows], np.float64)
    if not len(drawn):
        return drawn
    chosen, nearest = [0], drawn @ drawn[0]
    while len(chosen) < min(wanted, len(drawn)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, drawn @ drawn[chosen[-1]])
    return drawn[chosen]


def indexed(rows: DataFrame, heads: DataFrame, pivots: np.ndarray) -> VectorIndex:
    """Deal the distinct vectors of (id, vector[, first, last]) to pivots and tiles."""
    key = F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")
    more = [c for c in heads.columns if c not in ("vector", "head", "first", "last")]
    plain = heads.select("vector", "head", *key, *more)

    matrix = _matrix()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = matrix(batch.column("vector")) @ pivots.T
                cluster = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(near)), cluster], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(angle)],
                                                 names=[*batch.schema.names, "cluster", "angle"])

    schema = StructType([*plain.schema.fields, StructField("cluster", IntegerType()), StructField("angle", DoubleType())])
    dealt = checkpointed(plain.mapInArrow(deal, schema))
    by = F.col("first").cast("double") if "first" in rows.columns else F.col("angle")
    sizes = dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.percentile_approx(
        by, [i / BANDS for i in range(1, BANDS)], 1000).alias("cuts"))
    bands = F.least(F.lit(BANDS), F.ceil(F.col("n") / TILE_ROWS)).cast("int")
    sizes = sizes.withColumn("bands", bands).withColumn("cuts", F.when(F.col("bands") > 1, F.transform(
        F.sequence(F.lit(1), F.col("bands") - 1), lambda i: F.element_at("cuts", F.floor(i * BANDS / F.col("bands")).cast("int")))).otherwise(
        F.array().cast("array<double>")))
    placed = dealt.join(F.broadcast(sizes), "cluster").withColumn("band", F.size(F.filter("cuts", lambda c: c < by))).drop("n")
    # Equal vectors fall into one band, which may hold any share of the rows; there are BANDS a pivot at most.
    held = placed.groupBy("cluster", "band").agg(F.ceil(F.count("*") / TILE_ROWS).alias("parts"))
    placed, parts = placed.join(F.broadcast(held), ["cluster", "band"]), F.col("parts")
    tile = (F.col("cluster").cast("long") * BANDS + F.col("band")) * (1 << 32) + F.pmod(F.xxhash64("head"), parts)
    placed = checkpointed(placed.select(tile.alias("tile"), "cluster", "head", "vector", "angle", "first", "last", *more))
    tiles = placed.groupBy("tile", "cluster").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("first").alias("first"),
                                                  F.max("last").alias("last"), F.count("*").alias("n"))
    members = rows.filter("vector is not null").select("id", "vector").join(heads.select("vector", "head"), "vector").select("id", "head")
    return VectorIndex(members, placed.select("tile", "head", "vector", *more), checkpointed(tiles))


def tile_pairs(left: VectorIndex, right: VectorIndex, pivots: np.ndarray, floor: float, halved: bool = False) -> DataFrame:
    """(i, j): tiles that may hold a pair at the floor; ``halved`` gives those of one index with itself once."""
    limit = float(np.arccos(min(max(floor, -1.0), 1.0))) + SLACK
    spark = left.tiles.sparkSession
    widths = []
    for side in (left, right):
        width = np.full(len(pivots), -np.inf)
        for row in side.tiles.groupBy("cluster").agg(F.max("high").alias("high")).collect():  # a row per pivot
            width[row.cluster] = row.high
        widths.append(width)
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    p, q = np.nonzero(apart - widths[0][:, None] - widths[1][None] <= limit)
    reach = spark.createDataFrame(pd.DataFrame({"p": p, "q": q, "t": apart[p, q]}), "p int, q int, t double")
    x, y = left.tiles.alias("x"), right.tiles.alias("y")
    t = F.col("t")
    rules = ((t - F.col("x.high") - F.col("y.high") <= limit) & (F.col("x.low") - t - F.col("y.high") <= limit)
             & (F.col("y.low") - t - F.col("x.high") <= limit)
             & (F.col("x.first") <= F.col("y.last")) & (F.col("y.first") <= F.col("x.last")))
    if halved:
        rules &= F.col("x.tile") <= F.col("y.tile")
    return x.join(F.broadcast(reach), F.col("x.cluster") == F.col("p")).join(y, F.col("y.cluster") == F.col("q")).filter(rules).select(
        F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))


def _multiplied(left: VectorIndex, right: VectorIndex, pairs: DataFrame, floor: float) -> DataFrame:
    """(ha, hb, similarity) of heads at or above the floor in the given pairs of tiles."""
    key = left.rows.schema["head"].dataType.simpleString()

    def multiply(rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or columns.empty:
            return pd.DataFrame({"ha": [], "hb": [], "similarity": []})
        x, y = (np.stack(d["vector"].to_numpy()).astype(np.float64) for d in (rows, columns))
        products = x @ y.T
        at = np.argwhere(products >= floor)
        return pd.DataFrame({"ha": rows["head"].to_numpy()[at[:, 0]], "hb": columns["head"].to_numpy()[at[:, 1]],
                             "similarity": products[at[:, 0], at[:, 1]]})

    def side(index: VectorIndex, tile: str):
        rows = index.rows.withColumnRenamed("tile", tile).join(pairs, tile).select("i", "j", "head", "vector")
        return rows.toDF("i", "j", "head", "vector").groupBy("i", "j")

    return side(left, "i").cogroup(side(right, "j")).applyInPandas(multiply, f"ha {key}, hb {key}, similarity double")


def _of_members(found: DataFrame, left: VectorIndex, right: VectorIndex) -> DataFrame:
    side = lambda index, n: index.members.select(F.col("id").alias(n), F.col("head").alias(f"h{n}"))
    return found.join(side(left, "a"), "ha").join(side(right, "b"), "hb").select("a", "b", "similarity")


def near_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, similarity) of left and right rows (id, vector) whose product is at or above ``floor``.

    With columns ``first`` and ``last`` (days as numbers), pairs whose spans do not meet need not come out."""
    heads = [_heads(left), _heads(right)]
    pivots = chosen_pivots(heads[1])
    if not len(pivots) or heads[0].isEmpty():
        return left.select(F.col("id").alias("a")).filter("false").join(right.select(F.col("id").alias("b"))).withColumn("similarity", F.lit(0.0))
    x, y = indexed(left, heads[0], pivots), indexed(right, heads[1], pivots)
    pairs = checkpointed(tile_pairs(x, y, pivots, floor))
    return _of_members(_multiplied(x, y, pairs, floor), x, y)


def _squares(index: VectorIndex, pairs: DataFrame) -> DataFrame:
    """The rows of the index for each square of tiles that needs them: (u, v, side, place, mask, ...). A row of the first side
    is multiplied with the tiles of the second side whose places are set in its mask."""
    count = index.tiles.count()
    width = min(SQUARE, max(1, count // SQUARES))
    n = F.col("position") - 1
    at = checkpointed(with_position(index.tiles.select("tile"), [F.col("tile")], "position").select(
        "tile", F.floor(n / width).alias("square"), (n % width).cast("int").alias("place")))
    of = lambda tile, square, place: at.toDF(tile, square, place)
    met = pairs.join(of("i", "u", "p"), "i").join(of("j", "v", "q"), "j")
    none = F.lit(0).cast("bigint")
    first = met.groupBy("u", "v", F.col("i").alias("tile"), F.col("p").alias("place")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("q"))).alias("mask")).withColumn("side", F.lit(0))
    second = met.select("u", "v", F.col("j").alias("tile"), F.col("q").alias("place"), none.alias("mask"), F.lit(1).alias("side")).distinct()
    return index.rows.join(first.unionByName(second), "tile")


def near_pairs_within(rows: DataFrame, floor: float, judged: Sequence[str] = (), carried: Sequence[str] = (),
                      wanted: Callable[[dict, dict, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(a, b, similarity) with a < b of rows (id, vector) whose product is at or above ``floor``; an id is held by one row.

    ``wanted`` is asked where a pair is found: it gets the ``judged`` columns of both sides as arrays by name, and the similarities,
    and tells which pairs go on. Of those, the ``carried`` columns come out too, as a_name and b_name."""
    of = lambda n: [F.col(c).alias(f"{n}_{c}") for c in carried]
    pivots = chosen_pivots(_heads(rows))
    if not len(pivots):
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity"), *of("a"), *of("b")).filter("false")
    day = lambda c: F.col(c) if c in rows.columns else F.lit(0).alias(c)
    own = list(dict.fromkeys([*judged, *carried]))
    heads = rows.filter("vector is not null").select("vector", F.col("id").alias("head"), day("first"), day("last"), *own)
    x = indexed(rows, heads, pivots)
    pairs, matrix = checkpointed(tile_pairs(x, x, pivots, floor, halved=True)), _matrix()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).combine_chunks()
        array = lambda name: held.column(name).combine_chunks()
        number = lambda name: array(name).to_numpy(zero_copy_only=False)
        vectors, side, place, mask, tile, ids = matrix(array("vector")), *map(number, ("side", "place", "mask", "tile", "head"))
        known = {c: number(c) for c in judged}
        right = {q: np.flatnonzero((side == 1) & (place == q)) for q in np.unique(place[side == 1])}
        for p in np.unique(place[side == 0]):
            left = np.flatnonzero((side == 0) & (place == p))
            for q, columns in right.items():
                if not mask[left[0]] >> int(q) & 1:
                    continue
                same, step = tile[left[0]] == tile[columns[0]], max(1, CELLS // len(columns))
                for start in range(0, len(left), step):
                    products = vectors[left[start:start + step]] @ vectors[columns].T
                    i, j = np.nonzero(products >= floor)
                    similarity, i, j = products[i, j], left[start + i], columns[j]
                    keep = ids[i] < ids[j] if same else ids[i] != ids[j]
                    if wanted is not None:
                        keep &= wanted({c: v[i] for c, v in known.items()}, {c: v[j] for c, v in known.items()}, similarity)
                    similarity, i, j = similarity[keep], i[keep], j[keep]
                    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
                    for k in range(0, len(i), OUT_ROWS):
                        a, b = pa.array(i[k:k + OUT_ROWS]), pa.array(j[k:k + OUT_ROWS])
                        yield pa.RecordBatch.from_arrays(
                            [array("head").take(a), array("head").take(b), pa.array(similarity[k:k + OUT_ROWS]),
                             *[array(c).take(n) for n in (a, b) for c in carried]], names=schema.names)

    type_ = lambda name, c: StructField(name, heads.schema[c].dataType)
    schema = StructType([type_("a", "head"), type_("b", "head"), StructField("similarity", DoubleType()),
                         *[type_(f"{n}_{c}", c) for n in "ab" for c in carried]])
    return _squares(x, pairs).groupBy("u", "v").applyInArrow(multiply, schema)


def as_day(date: Column) -> Column:
    return F.unix_date(date).cast("int")
