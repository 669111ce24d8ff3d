"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, of toxic and of ordinary documents, over all words of the counting folds; a text's first word follows a start
symbol. P(w | v) discounts the class's bigram counts, backs off to the class's continuation shares of w, and
these to continuation shares over both classes together, so an expression that one class hardly has
gets the shared estimate there. A document's score compares the two log-likelihoods, normalised by its length (by the number
of words and by its root), beside the largest ratio of its words' own shares (at least that of an unknown word), on a scale fitted by
logistic regression on a fold that the counts do not use.

The log-likelihood ratio of a text is a sum over its words: a value for each word as what follows, one for each as what precedes, and a
correction for each bigram that was counted. All of these are entries of one stored table, which grows with the data. The
``HEAD`` most frequent entries are broadcast; the others are joined: a filter of ``SLICES`` slices of bits, also broadcast and of fixed
size, tells which of a text's words and bigrams may be among them, and only these travel, with their number in the text. A false
alarm of the filter finds no entry, so nothing is lost or added. Keys that many texts hold are split.

The scale is fitted on about ``SCALE_ROWS`` labelled rows at most, chosen by a hash of their id.

Defined results: a null or empty text scores like the average document; repeated rows score alike;
without labels of both classes every score is 0; extra columns pass through ``scored``, whose score takes the place of a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import WordHashes, free_names, small_batches, stored
from antecede.operators.heavyjoin import heavy_join
from antecede.session import discard

HEAD = 500_000  # entries that are broadcast, twelve bytes each; the rest is joined
BROADCAST_WORDS = 2_000_000  # words whose shares tasks may hold when the entries are made, 56 bytes each
COUNTS = 50_000  # counts from here on are alike when the least count of the head is chosen
SLICES, SLICE_BITS = 64, 21  # of the filter of the other entries: 2 ** 21 bits each
SCALE_ROWS = 20_000
BROADCAST_LABELS = 1_000_000  # labelled ids that may be broadcast
BROADCAST_KEYS = 500_000  # row keys that may be broadcast
DISCOUNT = 0.95
FOLDS = 4
HELD_OUT = 2  # never learned from
SCALE_FOLD = 3  # fits the scale
STRIP = b".,;:!?\"'()[]{}%&$*#|<>"
TURN = 23
START = np.uint64(0x1D8E4E27C47D124F)  # stands for what precedes the first word
FOLLOWS, PRECEDES = 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85  # tell the keys of a word's two values apart
SIDES = ("ordinary", "toxic")


def fold(key: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32(key as text) mod ``folds``; a null key falls in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0))


def words(text: str) -> list[bytes]:
    return [w.strip(STRIP) for w in text.lower().encode("utf-8", "surrogatepass").split()]


def _pairs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What precedes each word, and the key of the bigram: the hashes of both words, one turned by ``TURN`` bits."""
    before = np.concatenate([[START], hashes[:-1]]) if len(hashes) else hashes
    return before, before ^ (hashes << np.uint64(TURN) | hashes >> np.uint64(64 - TURN))


def _pair_key() -> Column:
    """The same key of columns v and w."""
    return F.col("v").bitwiseXOR(F.shiftleft("w", TURN).bitwiseOR(F.shiftrightunsigned("w", 64 - TURN)))


@dataclass
class Model:
    keys: np.ndarray  # sorted keys of the broadcast entries
    values: np.ndarray
    bits: np.ndarray  # filter of the other entries
    tail: DataFrame  # (key, value) of the other entries
    unknown: float  # value of a word that was never counted
    scale: np.ndarray | None = None


def _counted(rows: DataFrame) -> DataFrame:
    """(v, w, ordinary, toxic) of all bigrams, summed per task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hash_of = WordHashes()
        kept: dict[int, list[np.ndarray]] = {0: [], 1: []}

        def flush(label: int) -> pd.DataFrame:
            w = np.concatenate(kept[label])
            v, key = (np.concatenate(x) for x in zip(*[_pairs(h) for h in kept[label]]))
            kept[label] = []
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            return pd.DataFrame({"v": v[at].view(np.int64), "w": w[at].view(np.int64), "toxic": np.int32(label), "n": n.astype(np.int64)})

        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                kept[int(label == 1)].append(hash_of.fresh().of(words(text)))
            for label in (0, 1):
                if sum(map(len, kept[label])) > 3_000_000:
                    yield flush(label)
        for label in (0, 1):
            if kept[label]:
                yield flush(label)

    side = lambda value: F.sum(F.when(F.col("toxic") == value, F.col("n")).otherwise(0))
    return rows.mapInPandas(count, "v long, w long, toxic int, n long").groupBy("v", "w").agg(
        side(0).alias("ordinary"), side(1).alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, text, label) of documents with one; labels that disagree for an id count as 1."""
    known = stored(labels.filter(f"doc_id is not null and {column} is not null").groupBy("doc_id").agg(
        F.max(F.col(column).cast("int")).alias(column)), "labels")
    few = known.count() <= BROADCAST_LABELS  # else texts are shuffled to their labels
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")


def _columns(rows: DataFrame, key: str, names: list[str]) -> list[np.ndarray]:
    """The key's values in order, and each column's beside them; one column is copied at a time."""
    table = rows.select(key, *names).toArrow()
    order = np.argsort(table.column(key).to_numpy())
    out = []
    for name in (key, *names):
        out.append(table.column(name).to_numpy()[order])
        table = table.drop_columns([name])
    return out


def _corrected(pairs: DataFrame, by_word: DataFrame, by_context: DataFrame) -> DataFrame:
    """(key, value, n) of every bigram; each task looks the shares of its words up in sorted arrays."""
    follows = _columns(by_word, "w", [f"{c}_p" for c in SIDES])
    precedes = _columns(by_context, "v", [f"{c}_{x}" for x in ("n", "back") for c in SIDES])
    held = pairs.sparkSession.sparkContext.broadcast((follows[0], follows[1:], precedes[0], precedes[1:3], precedes[3:]))
    del follows, precedes

    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_, share, contexts, seen, back = held.value
        for batch in batches:
            at, of = np.searchsorted(words_, batch["w"]), np.searchsorted(contexts, batch["v"])
            logs = []
            for c, side in enumerate(SIDES):
                backed = back[c][of] * share[c][at]
                logs.append(np.log((np.maximum(batch[side].to_numpy() - DISCOUNT, 0) / np.maximum(seen[c][of], 1) + backed) / backed))
            w = batch["w"].to_numpy(np.int64).view(np.uint64)
            key = batch["v"].to_numpy(np.int64).view(np.uint64) ^ (w << np.uint64(TURN) | w >> np.uint64(64 - TURN))
            yield pd.DataFrame({"key": key.view(np.int64), "value": (logs[1] - logs[0]).astype(np.float32),
                                "n": (batch["ordinary"] + batch["toxic"]).to_numpy(np.int64)})

    return pairs.mapInPandas(correct, "key long, value float, n long")


def _entries(pairs: DataFrame, totals) -> tuple[DataFrame, float]:
    """(key, value, n) of every word as what follows, as what precedes, and of every bigram, stored; and the value of an unknown
    word. ``pairs`` and the shares of words are spent then and deleted."""
    size = totals.words + 1

    def follows(both: Column, kinds: dict[str, Column]) -> dict[str, Column]:
        shared = (both + 0.5) / (totals.both + 0.5 * size)
        return {c: (F.greatest(kinds[c] - DISCOUNT, F.lit(0.0)) + DISCOUNT * totals[f"{c}_words"] * shared) / max(totals[f"{c}_kinds"], 1)
                for c in SIDES}

    by_word = pairs.groupBy("w").agg(F.count("*").alias("both"), F.sum(F.col("ordinary") + F.col("toxic")).alias("n"), *[
        F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in SIDES])
    p = follows(F.col("both"), {c: F.col(f"{c}_kinds") for c in SIDES})
    by_word = stored(by_word.select("w", "n", *[p[c].alias(f"{c}_p") for c in SIDES]), "follows")
    none = follows(F.lit(0), {c: F.lit(0) for c in SIDES})
    unknown = pairs.sparkSession.range(1).select((F.log(none["toxic"]) - F.log(none["ordinary"])).alias("u")).first().u
    by_context = pairs.groupBy("v").agg(*[F.sum(c).alias(f"{c}_n") for c in SIDES], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in SIDES])
    back = {c: F.when(F.col(f"{c}_n") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0) for c in SIDES}
    by_context = stored(by_context.select("v", *[F.col(f"{c}_n") for c in SIDES], *[back[c].alias(f"{c}_back") for c in SIDES]), "precedes")
    ratio = lambda name: F.log(F.col(f"toxic_{name}")) - F.log(F.col(f"ordinary_{name}"))
    value = lambda c: c.cast("float").alias("value")
    if max(by_word.count(), by_context.count()) <= BROADCAST_WORDS:
        corrected = _corrected(pairs, by_word, by_context)
    else:  # a word that many bigrams hold is split over tasks
        joined = heavy_join(heavy_join(pairs, by_word.drop("n"), ["w"]), by_context, ["v"])
        share = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_n"), F.lit(1)) + F.col(f"{c}_back") * F.col(f"{c}_p")
                 for c in SIDES}
        corrected = joined.select(_pair_key().alias("key"), value(F.log(share["toxic"]) - F.log(share["ordinary"]) - ratio("back") - ratio("p")),
                                  (F.col("ordinary") + F.col("toxic")).alias("n"))
    entries = stored(corrected.unionByName(
        by_word.select(F.col("w").bitwiseXOR(F.lit(FOLLOWS)).alias("key"), value(ratio("p") - unknown), "n")).unionByName(
        by_context.select(F.col("v").bitwiseXOR(F.lit(PRECEDES)).alias("key"), value(ratio("back")),
                          (F.col("ordinary_n") + F.col("toxic_n")).alias("n"))), "entries")
    for spent in (pairs, by_word, by_context):
        discard(spent)
    return entries, unknown


def _least(entries: DataFrame, bound: int) -> int:
    """The smallest count that at most ``bound`` entries reach; nothing but a histogram is collected."""
    histogram = sorted((r.n, r.rows) for r in entries.groupBy(F.least("n", F.lit(COUNTS)).alias("n")).agg(F.count("*").alias("rows")).collect())
    least, total = COUNTS + 1, 0
    for value, rows in reversed(histogram):
        total += rows
        if total > bound:
            break
        least = value
    return least


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """The bits of keys within their slice."""
    mask = np.uint64((1 << SLICE_BITS) - 1)
    return [((keys >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, 19, 37)]


def _filter(tail: DataFrame) -> np.ndarray:
    """Bits of all keys, a row of bytes for each slice; a slice is made by one task."""
    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << SLICE_BITS, bool)
        for at in _places(frame["key"].to_numpy(np.int64).view(np.uint64)):
            flags[at] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros((SLICES, 1 << SLICE_BITS >> 3), np.uint8)
    number = F.shiftrightunsigned("key", 64 - SLICES.bit_length() + 1).cast("int")
    for row in tail.select(number.alias("slice"), "key").groupBy("slice").applyInPandas(fill, "slice int, bits binary").collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint8)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    part = (keys >> np.uint64(64 - SLICES.bit_length() + 1)).astype(np.int64)
    found = np.ones(len(keys), bool)
    for at in _places(keys):
        found &= (bits[part, at >> 3] >> (at & 7) & 1).astype(bool)
    return found


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model of the labelled documents; rows of the held-out fold are never read."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, "toxic").withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT)
    pairs = stored(_counted(rows.filter(F.col("fold") != SCALE_FOLD).select("text", "toxic")), "bigrams")
    kinds = pairs.groupBy("w").agg(F.count("*").alias("both"), *[F.count_if(F.col(c) > 0).alias(c) for c in SIDES])
    totals = kinds.agg(F.count("*").alias("words"), F.sum("both").alias("both"), *[F.sum(c).alias(f"{c}_kinds") for c in SIDES],
                       *[F.count_if(F.col(c) > 0).alias(f"{c}_words") for c in SIDES]).first()
    if not totals.words or not totals.ordinary_kinds or not totals.toxic_kinds:
        return None
    entries, unknown = _entries(pairs, totals)
    least = _least(entries, HEAD)
    head = entries.filter(F.col("n") >= least).select("key", "value").toPandas()
    keys = head["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    tail = entries.filter(F.col("n") < least).select("key", "value")
    model = Model(keys[order], head["value"].to_numpy(np.float32)[order], _filter(tail), tail, unknown)
    sample = rows.filter(F.col("fold") == SCALE_FOLD)
    share = min(1.0, SCALE_ROWS / max(sample.count(), 1))
    sample = sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    seen = _ratios(sample.select("text", "toxic"), model, ["toxic"]).select("toxic", *_features()).toPandas()
    model.scale = _logistic(seen[["mean", "root", "peak"]].to_numpy(np.float64), seen["toxic"].to_numpy(np.float64))
    return model


def _features() -> list[Column]:
    n = F.greatest("n", F.lit(1))
    return [(F.col("ratio") / n).alias("mean"), (F.col("ratio") / F.sqrt(n)).alias("root"), F.col("peak")]


def _ratios(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(keep, n, ratio, peak): words of each text, its toxic less ordinary log-likelihood, and the largest value of a word beyond
    that of an unknown one."""
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.values, model.bits, model.unknown))
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values, bits, unknown = held.value
        hash_of = WordHashes()
        for batch in batches:
            found = [hash_of.fresh().of(words(t)) if isinstance(t, str) and t else np.zeros(0, np.uint64) for t in batch["text"]]
            ratio, peak, rest, times = np.zeros(len(found)), np.zeros(len(found)), [], []
            for i, w in enumerate(found):
                v, both = _pairs(w)
                wanted = np.concatenate([w ^ np.uint64(FOLLOWS), v ^ np.uint64(PRECEDES), both])
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                value = np.where(hit, values[at], 0) if len(keys) else np.zeros(len(wanted))
                ratio[i] = value.sum(dtype=np.float64) + unknown * len(w)
                peak[i] = value[:len(w)].max(initial=0.0)
                own, n_own, other, n_other = (x for miss in (wanted[:len(w)][~hit[:len(w)]], wanted[len(w):][~hit[len(w):]])
                                              for x in np.unique(miss[_maybe(bits, miss)], return_counts=True))
                rest.append(np.concatenate([own, other]).view(np.int64))
                times.append(np.concatenate([n_own, -n_other]).astype(np.int32))  # below zero: not a word's own
            yield batch[keep].assign(n=[len(w) for w in found], base=ratio, top=peak, keys=rest, times=times)

    coded = docs.select(*keep, "text").mapInPandas(code, f"{types}, n int, base double, top double, keys array<long>, times array<int>")
    coded = stored(coded.withColumn("row_", F.monotonically_increasing_id()), "coded")
    listed = coded.select("row_", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row_", F.col("x.keys").alias("key"), "x.times")
    sums = heavy_join(listed, model.tail, ["key"]).groupBy("row_").agg(
        F.sum(F.abs("times") * F.col("value").cast("double")).alias("more"),
        F.max(F.when(F.col("times") > 0, F.col("value").cast("double"))).alias("high"))
    return coded.drop("keys", "times").join(sums, "row_", "left").select(
        *keep, "n", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("ratio"), F.greatest("top", "high").alias("peak"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Rows: offset, spread and weight of each feature; the last weight is the intercept. Newton steps."""
    if not len(y):
        return np.array([[0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 0.0, 0.0]])
    offset, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - offset) / spread, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        b += np.linalg.solve(hessian, z.T @ (y - p) - ridge * b)
    return np.vstack([np.append(offset, 0.0), np.append(spread, 1.0), b])


def scores(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document and its ``score``, 0 to 1; texts stay where they are."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    offset, spread, weight = model.scale
    z = F.lit(float(weight[-1]))
    for i, feature in enumerate(("mean", "root", "peak")):
        z = z + (F.col(feature) - float(offset[i])) / float(spread[i]) * float(weight[i])
    rows = _ratios(docs, model, keep).select(*keep, *_features())
    return rows.select(*keep, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def text_key() -> list[Column]:
    """What tells the scores of rows apart: a digest of the text, null for none."""
    return [F.xxhash64(F.coalesce("text", F.lit(""))), F.length(F.coalesce("text", F.lit("")))]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``score``, 0 to 1, to every document."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    names = free_names(docs, "text_hash", "text_length")
    docs = docs.drop("score").withColumns(dict(zip(names, text_key())))
    found = stored(scores(docs, model, names), "scores").groupBy(*names).agg(F.min("score").alias("score"))
    return heavy_join(docs, found, names).drop(*names)


def without(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The documents that score below the threshold; texts are shuffled only when very many do not."""
    if model is None:
        return docs
    names = free_names(docs, "text_hash", "text_length")
    keyed = docs.withColumns(dict(zip(names, text_key())))
    gone = stored(scores(keyed, model, names).filter(F.col("score") >= threshold).select(*names).distinct(), "toxic")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return keyed.join(gone, names, "left_anti").select(*docs.columns)
