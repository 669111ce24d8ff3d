"""Mixing sources to target weights with a low-discrepancy schedule.

Sources share the words of all documents by weight. A target stops at ``PASSES`` times its source's size, and what is
left over is shared again: the targets are the one water level at which everything is given out.

The schedule has a slot per block of words. The slot's van der Corput point (its bits reversed) falls into the cumulative slot
counts of the sources and so names its source; points beyond the last source are skipped. Any run of slots therefore
holds every source in its share, up to the logarithm of its length. Slots are ranked per source, and the
slot of rank r takes block r modulo the source's blocks. Blocks are cut from the source's documents, laid end to end
in the order of a seeded hash, every ``block`` words; the last one of a source may be shorter.

A source gets the rounded number of slots that its target asks for, so its words differ from the target by less than two
blocks, and never pass ``PASSES`` times its size; neither does a document. A block has total / ``SLOTS`` words, from one to
``MOST_WORDS`` of them, so blocks are small against any source that matters and grow with the data up to a page or two.

Only column expressions. Texts are never shuffled. Places and running totals come from range partitions over all rows, so a
source with a third of the rows is spread like any other, as are rows without an id and rows that repeat.

Defined results: a null text has no words; a null source is a source, the last; a source without words keeps its
weight's place and gets nothing; documents without words are taken 0 times; rows that share an id are rows of their own; equal
rows may swap their places, which leaves the result the same; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import joined_small, stored, words_of
from antecede.operators.ordering import with_position, with_running_total

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
PASSES = 3
SLOTS = 1 << 20
MOST_WORDS = 4096
SEED = "mix"
RUN = 4096  # neighbouring points that one row of the sources is spread into


class Mix(NamedTuple):
    """``sources``: (name, absent, place, source_size, target, n_blocks, first, slots), ``rows``: documents with their place in
    the source's stream, ``block`` words a block."""

    sources: DataFrame
    rows: DataFrame
    block: int


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def targeted(sizes: DataFrame) -> DataFrame:
    """Add place, weight and target to (name, absent, source_size); targets sum to the sum of the sizes."""
    placed = with_position(sizes, [F.col("absent"), F.col("name")], "place").withColumn(
        "weight", F.element_at(F.lit(list(WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")).withColumn(
        "most", PASSES * F.col("source_size"))
    whole = placed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if whole.words is None:
        return placed.withColumn("target", F.lit(0.0))
    # In the order of what a source can take per weight, the full ones come first.
    order = [F.col("most") / F.col("weight"), F.col("place")]
    level = with_running_total(placed, order, F.col("most"), "given")
    level = with_running_total(level, order, F.col("weight"), "passed").withColumns({
        "rest": F.lit(whole.words).cast("long") - F.col("given"), "sharing": F.lit(whole.weight).cast("long") - F.col("passed")})
    level = stored(level.withColumn("full", _whole("most") * _whole("sharing") <= _whole("weight") * _whole("rest")), "levels")
    open_ = level.filter("not full").agg(F.min_by(F.struct("rest", "sharing"), F.struct(*order)).alias("at")).first().at
    rest, sharing = (open_.rest, open_.sharing) if open_ else (0, 1)
    shared = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(sharing))
    return level.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(shared)).drop(
        "given", "passed", "rest", "sharing", "full")


def planned(docs: DataFrame, seed: str = SEED) -> Mix:
    """Targets and slot counts of the sources, and every document's place in its source's shuffled stream."""
    rows = docs.select(
        F.col("doc_id"), F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("absent"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "sized")
    sources = stored(targeted(rows.groupBy("name", "absent").agg(F.sum("size").alias("source_size"))), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = min(max(-(-total // SLOTS), 1), MOST_WORDS)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn(
        "slots", F.when(F.col("source_size") > 0, F.floor(
            F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    sources = stored(with_running_total(sources, [F.col("place")], F.col("slots"), "first"), "sources")
    before = with_running_total(sources.select("place", "source_size"), [F.col("place")], F.col("source_size"), "before")
    named = joined_small(rows, sources.join(before.select("place", "before"), "place").select(
        "name", "absent", "place", "source_size", "target", "before"), ["name", "absent"])
    mixed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    laid = with_running_total(named, [F.col("place"), mixed, F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "start")
    return Mix(sources, laid.withColumn("start", F.col("start") - F.col("before")).drop("before", "name", "absent"), block)


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, place, turn, block): the source and block of every slot; points beyond the sources leave gaps between slots."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(int(total - 1).bit_length(), 1) if total else 1
    end = F.col("first") + F.col("slots")
    runs = sources.filter("slots > 0").select("place", "n_blocks", "first", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("first") / RUN), F.floor((end - 1) / RUN))).alias("run")).repartition("place", "run")
    point = F.explode(F.sequence(F.greatest("first", F.col("run") * RUN), F.least("end", (F.col("run") + 1) * RUN) - 1))
    points = runs.select("place", "n_blocks", "first", point.alias("point"))
    reversed_ = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    ranked = with_position(points.select("place", "n_blocks", "first", reversed_.alias("slot")), [F.col("place"), F.col("slot")])
    turn = F.col("position") - 1 - F.col("first")  # the points of a source are as many as its slots
    return ranked.select("slot", "place", turn.alias("turn"), (turn % F.col("n_blocks")).alias("block"))


def pieces(mix: Mix) -> DataFrame:
    """(row, place, block, words, ...): the part of each document that lies in each block; documents without words have one of none."""
    first, last = F.col("start"), F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(first / mix.block), F.floor((last - 1) / mix.block))).otherwise(
        F.array((-1 - F.pmod(F.col("row"), F.lit(RUN))).cast("long")))  # beside all blocks, and spread
    return mix.rows.withColumn("block", F.explode(blocks)).withColumn("words", F.when(F.col("size") > 0, F.least(
        last, (F.col("block") + 1) * mix.block) - F.greatest(first, F.col("block") * mix.block)).otherwise(0))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The pieces of documents in the order of their slots; ``slot`` is null for a piece the mix never takes."""
    mix = planned(docs, seed)
    return pieces(mix).join(schedule(mix.sources), ["place", "block"], "left")


def taken(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    return mixed(docs, seed).groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken")).drop("row")
