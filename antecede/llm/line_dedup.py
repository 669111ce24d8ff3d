"""Line dedup with a segment-partition edit join.

Two lines within ``TAU`` edits share at least one of the ``TAU + 1`` segments of the shorter one, at a
position that the multi-match windows bound. Every distinct line indexes its own segments and probes
the substrings of each permitted length; only keys that different lines share survive. Parity
signatures of the characters and of their pairs (an edit flips few bits) thin what a shared segment pairs, and
keys shared by many lines are split by parts of the signature, one of which must agree. What
remains is verified with a banded bit-parallel edit distance. Lines linked by near copies form a class,
of which the first occurrence stays.

Only column expressions. Equal lines collapse first, so a line in a third of all documents is one
row; a hot segment is split and never meets itself in full.

Defined results: only lines of ``MIN_CHARS`` characters or more are probed for near copies; exact repeats go
from ``shortest`` characters up, which is 1 in op7 and the pipeline; shorter lines, and blank ones below
``MIN_CHARS``, stay and drop nothing; positions are ordered by document id (null first), text hash, and line number; rows repeating both id and text count
as one document; a null text stays null. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import WORD_PATTERN, stored
from antecede.llm.decontamination import keyed
from antecede.operators.components import connected_components

TAU = 2
MIN_CHARS = 20  # of a line that is probed for near copies
HOT_KEY = 64  # lines on one segment key beyond which it is split by signature parts
BROADCAST_IDS = 2_000_000  # line ids that may be broadcast
BROADCAST_NUMBERS, DOCUMENT_COST = 8_000_000, 10  # line numbers that may be broadcast; a document counts as ten
PARTS = 2 * TAU + 1  # of the signature: 2 * TAU flipped bits leave one part equal


def _occurrences(docs: DataFrame, shortest: int) -> DataFrame:
    """Lines long enough to judge, with their position."""
    judged = (F.length("line") >= shortest) & ((F.length("line") >= MIN_CHARS) | F.col("line").rlike(WORD_PATTERN))
    return keyed(docs.select("doc_id", "text")).select(
        "_id", "_th", F.posexplode_outer(F.split("text", "\n")).alias("no", "line")).filter(judged)


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """1-based start and length of the even segments of a line; the last ones are the longer ones."""
    base, longer = F.floor(length / (TAU + 1)).cast("int"), (length % (TAU + 1)).cast("int")
    return [((F.lit(i) * base + F.greatest(longer - (TAU + 1 - i), F.lit(0)) + 1).cast("int"),
             base + F.when(longer >= TAU + 1 - i, 1).otherwise(0)) for i in range(TAU + 1)]


def _keys(line: Column) -> tuple[list[Column], list[Column]]:
    """Index keys of a line, and the keys it probes for lines as long or up to TAU shorter."""
    def key(i: int, length: Column, start: Column, size: Column) -> Column:
        return F.xxhash64(F.lit(i), length, F.substring(line, start, size))

    own = F.length(line)
    index = [key(i, own, start, size) for i, (start, size) in enumerate(_segments(own))]
    probes = []
    for delta in range(TAU + 1):
        length = own - delta
        for i, (start, size) in enumerate(_segments(length)):
            first = max(-i, delta - (TAU - i))
            last = min(i, delta + (TAU - i))
            probes += [key(i, length, start + shift, size) for shift in range(first, last + 1)]
    return index, probes


def pair_signature(line: Column) -> Column:
    """Parities of the hashed pairs of neighbouring characters; an edit flips four at most."""
    pairs = F.element_at(F.transform(F.array(F.split(line, "")), lambda chars: F.transform(
        chars, lambda c, i: F.pmod(F.xxhash64(c, F.get(chars, i + 1)), F.lit(64)).cast("int"))), 1)
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), p)))


def signature(line: Column) -> Column:
    """Parities of the characters by code modulo 64; an edit flips two at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def within_edits(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether the edit distance is at most ``tau``, by a banded bit-parallel recurrence.

    ``a`` is not shorter than ``b``. Bit i of a column's words stands for pattern row
    column - tau + i; the distance is followed along the last diagonal of the band.
    """
    wide, ahead = 2 * tau + 1, F.length(a) - F.length(b)
    mask = F.lit((1 << wide) - 1).cast("long")
    bit = lambda i: F.lit(1 << i).cast("long")
    zero = F.lit(0).cast("long")

    def step(rows: Column, acc: Column, char: Column, col: Column) -> Column:
        equal = sum((F.when(F.get(rows, col - tau + i - 1) == char, bit(i)).otherwise(zero) for i in range(wide)), zero)
        bound = F.struct(equal.alias("x"), acc["vp"].alias("vp"), acc["vn"].alias("vn"))

        def diagonal(s: Column) -> Column:
            x, vp, vn = s["x"], s["vp"], s["vn"]
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)
            return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"))

        def horizontal(s: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(mask)
            return F.struct(s["d0"].alias("d0"), hp.alias("hp"), s["d0"].bitwiseAND(s["vp"]).alias("hn"))

        def moved(s: Column) -> Column:
            down = F.shiftright(s["d0"], 1)
            vp = s["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(s["hp"]))).bitwiseAND(mask)
            same = F.getbit(s["d0"], ahead + tau) == 1
            return F.struct(vp.alias("vp"), down.bitwiseAND(s["hp"]).alias("vn"),
                            (acc["d"] + F.when(same, 0).otherwise(1)).alias("d"))

        chain = F.array(bound)
        for part in (diagonal, horizontal, moved):
            chain = F.transform(chain, part)
        return F.element_at(chain, 1)

    # Rows up to 0 lie above the pattern: no vertical step there, one in each row below.
    start = F.struct(F.lit(((1 << wide) - 1) & ~((1 << tau) - 1)).cast("long").alias("vp"), zero.alias("vn"),
                     ahead.cast("int").alias("d"))
    columns = F.transform(F.split(b, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("j")))
    rows = F.array(F.split(a, ""))
    distance = F.element_at(F.transform(rows, lambda r: F.aggregate(
        columns, start, lambda acc, s: step(r, acc, s["c"], s["j"]))["d"]), 1)
    return F.when(F.length(b) == 0, ahead <= tau).when(ahead > tau, F.lit(False)).otherwise(distance <= tau)


def near_lines(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of different lines within TAU edits; ``lines`` has distinct (id, line)."""
    index, probes = _keys(F.col("line"))
    keys = lines.select("id", F.posexplode(F.array(*index, *probes)).alias("slot", "k")).select(
        "k", (F.col("slot") > TAU).alias("probe"), "id").repartition("k")
    shared = keys.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"),
                                   F.min("probe").alias("only_probes"), F.count_if(~F.col("probe")).alias("n")).filter(
        "lo <> hi and not only_probes").select("k", "n")
    kept = stored(keys.join(shared, "k"), "segment_keys")
    ids = stored(kept.select("id").distinct(), "segment_ids")
    few = ids.count() <= BROADCAST_IDS  # else both sides are shuffled by id
    signed = stored(lines.select("id", "line").join(F.broadcast(ids) if few else ids, "id").select(
        "id", "line", F.length("line").alias("chars"), signature(F.col("line")).alias("sig"),
        pair_signature(F.col("line")).alias("pairs")), "segment_lines")
    width = 64 // PARTS + 1
    parts = F.array(*[F.concat_ws(":", F.lit(p), F.shiftrightunsigned("sig", p * width).bitwiseAND((1 << width) - 1))
                      for p in range(PARTS)])
    rows = kept.join(signed.drop("line"), "id").withColumn(
        "part", F.explode(F.when(F.col("n") > HOT_KEY, parts).otherwise(F.array(F.lit("")))))
    left = rows.filter("not probe").select("k", "part", F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("pairs").alias("pa"), F.col("chars").alias("ca"))
    right = rows.filter("probe").select("k", "part", F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("pairs").alias("pb"), F.col("chars").alias("cb"))
    close = (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * TAU) & (F.col("a") != F.col("b")) \
        & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 4 * TAU) \
        & F.col("cb").between(F.col("ca"), F.col("ca") + TAU)
    pairs = left.join(right, (left.k == right.k) & (left.part == right.part) & close).select("a", "b").distinct()
    pairs = stored(pairs, "line_pairs")
    texts = signed.select("id", "line")
    return pairs.join(texts.withColumnsRenamed({"id": "a", "line": "short"}), "a").join(
        texts.withColumnsRenamed({"id": "b", "line": "long"}), "b").filter(
        within_edits(F.col("long"), F.col("short"))).select("a", "b")


def dropped_lines(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """(_id, _th, gone): the numbers of the lines that repeat an earlier line, per document."""
    at = F.struct("_id", "_th", "no")
    lines = stored(_occurrences(docs, shortest).groupBy("line").agg(
        F.min(at).alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "lines")
    links = stored(near_lines(lines.filter(F.length("line") >= MIN_CHARS)), "line_links")
    component = connected_components(links)
    member = lines.join(component.withColumnRenamed("node", "id"), "id")
    head = member.groupBy("component").agg(F.min("first").alias("head"))
    near = member.join(head, "component").select("line", "head")
    alone = lines.filter("n > 1").join(component.select(F.col("node").alias("id")), "id", "left_anti").select(
        "line", F.col("first").alias("head"))
    hashes = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]
    heads = near.unionByName(alone).select(*hashes, "head")
    return _occurrences(docs, shortest).select("_id", "_th", "no", *hashes).join(heads, ["h1", "h2"]).filter(
        F.struct("_id", "_th", "no") != F.col("head")).groupBy("_id", "_th").agg(F.collect_set("no").alias("gone"))


def deduplicated(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """Documents with their repeated lines removed, plus n_lines and n_dropped."""
    gone = stored(dropped_lines(docs, shortest), "dropped_lines")
    few = gone.agg(F.sum(F.size("gone") + DOCUMENT_COST)).first()[0] or 0
    # A small table of line numbers goes to the texts; else both sides are shuffled by document.
    joined = keyed(docs).join(F.broadcast(gone) if few <= BROADCAST_NUMBERS else gone, ["_id", "_th"], "left").drop("_id", "_th")
    # The split is bound once per row, wherever Spark evaluates the expression.
    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform(
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))),
        lambda i: F.get(lines, i))), 1)
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    }).drop("gone")
