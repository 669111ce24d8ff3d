"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of order 3: counts of the byte that follows every context of up to
three bytes. A byte's code length is that of its longest known context; where the context never saw
the byte, an escape is paid, d / (n + d) for d kinds among n bytes, and the next shorter context
asked, down to equal shares of the 256 bytes. Statistics are frozen before scoring, so every code length is exact
and is looked up from sorted tables; a text gets the language that codes it in the fewest bits.

Counts cover all training rows, and every context that was counted is in the model, which so grows with the data. Its tables are cut into
shards of ``SHARD`` values at most (unless the runs of one pair of bytes have more: 65,536 a language), each with the runs
of its share of the contexts' last two bytes. One shard, the usual case, is broadcast and scores each text at once; several are broadcast one after
another, and a text's bits are summed over them. Only tables over pairs of bytes are common to all: their size depends on the
number of languages alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without training rows all
are ``und``; ties go to the language that sorts first; extra columns pass through ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import free_names, small_batches, stored

SHARD = 20_000_000  # values of a shard, two bytes each
BITS = 256  # fixed-point steps a bit
STEP = 4_000_000  # values that are looked up at once
UNKNOWN = "und"


@dataclass
class Shard:
    """Fixed-point bits by language, rows in the order of sorted keys: runs of four and of three bytes, and the escapes of
    contexts of three and of two bytes."""

    number: int
    keys: list[np.ndarray]
    bits: list[np.ndarray]


@dataclass
class Model:
    languages: list[str]
    counts: DataFrame  # (lang, code, n, shard)
    shards: int
    pairs: np.ndarray  # (previous byte * 256 + byte, language) -> share of the byte

    def shard(self, number: int) -> Shard:
        rows = self.counts.filter(F.col("shard") == number).select("lang", "code", "n").toPandas()
        return _shard(number, rows, self.languages, self.pairs)


def _inside(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n windows of four bytes do not reach into the next text."""
    inside = np.ones(n, bool)
    for k in range(1, 4):
        cut = starts[1:] - k
        inside[cut[cut < n]] = False
    return inside


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each after three line breaks, and where the texts start."""
    data = [b"\n\n\n" + t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, code, n) of runs of four bytes, summed per task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            unique, at = np.unique(code, return_inverse=True)
            return unique, np.bincount(at, n, len(unique)).astype(np.int64)

        for batch in batches:
            for lang, group in batch.groupby("lang"):
                data, starts = _codes(group["text"].tolist())
                if len(data) < 4:
                    continue
                b = data.astype(np.uint32)
                code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                parts = kept.setdefault(lang, [])
                parts.append(np.unique(code[_inside(len(code), starts)], return_counts=True))
                if len(parts) > 8:
                    kept[lang] = [merged(parts)]
        for lang, parts in kept.items():
            code, n = merged(parts)
            yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n})

    return rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a context by its last two bytes."""
    return pair.astype(np.int64) * 40_503 % 65_536 * shards >> 16


def _dense(counts: pd.DataFrame, key: str, size: int, languages: list[str]) -> np.ndarray:
    out = np.zeros((size, len(languages)))
    out[counts[key].to_numpy(np.int64), np.searchsorted(languages, counts["lang"].to_numpy(str))] = counts["n"]
    return out


def _escaped(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Share of a byte after a context that saw it n times, or through the escape."""
    whole = np.maximum(total + kinds, 1)
    return np.where(total == 0, shorter, np.where(n > 0, n / whole, kinds / whole * shorter))


def fitted(rows: DataFrame) -> Model | None:
    """Model of training rows (text, lang)."""
    small_batches(rows.sparkSession)
    counts = stored(_counted(rows.filter("text is not null and lang is not null").select("text", "lang")), "runs")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    pair = F.col("code").bitwiseAND(0xFFFF)
    by_pair = counts.groupBy("lang", pair.alias("pair")).agg(F.sum("n").alias("n")).toPandas()  # 65,536 a language at most
    n1 = _dense(by_pair, "pair", 65_536, languages).reshape(256, 256, -1)
    n0 = n1.sum(0)
    p0 = _escaped(n0, n0.sum(0), (n0 > 0).sum(0), np.full(n0.shape, 1 / 256))
    p1 = _escaped(n1, n1.sum(1, keepdims=True), (n1 > 0).sum(1, keepdims=True), p0[None])
    shards = min(65_536, -(-counts.select("code").distinct().count() * len(languages) // SHARD))
    c2 = F.shiftright("code", 8).bitwiseAND(0xFFFF)
    number = F.floor(c2 * 40_503 % 65_536 * shards / 65_536).cast("int")
    if shards > 1:
        counts = stored(counts.withColumn("shard", number).repartition("shard").sortWithinPartitions("shard"), "shards")
    else:
        counts = counts.withColumn("shard", F.lit(0))
    return Model(languages, counts, shards, p1.reshape(65_536, -1).astype(np.float32))


def _fixed(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log2(p) * BITS), 32_000).astype(np.int16)


def _shard(number: int, rows: pd.DataFrame, languages: list[str], pairs: np.ndarray) -> Shard:
    """Shares of all counted runs of the shard under every language, and the escapes of its contexts."""
    width = len(languages)
    code, at = np.unique(rows["code"].to_numpy(np.int64), return_inverse=True)
    n4 = np.zeros((len(code), width), np.float32)
    n4[at, np.searchsorted(languages, rows["lang"].to_numpy(str))] = rows["n"]

    def totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of sorted runs, where each run's is, and counts and kinds by context."""
        context, place = np.unique(key >> 8, return_inverse=True)
        first = np.searchsorted(place, np.arange(len(context)))
        return context, place, np.add.reduceat(n, first, 0), np.add.reduceat((n > 0).astype(np.float32), first, 0)

    def escapes(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return _fixed(np.where(total == 0, 1.0, kinds / np.maximum(total + kinds, 1)))

    code3, at3 = np.unique(code & 0xFFFFFF, return_inverse=True)
    n3 = np.zeros((len(code3), width), np.float32)
    np.add.at(n3, at3, n4)
    c2, place2, total2, kinds2 = totals(code3, n3)
    p3 = _escaped(n3, total2[place2], kinds2[place2], pairs[code3 & 0xFFFF])
    c3, place3, total3, kinds3 = totals(code, n4)
    p4 = _escaped(n4, total3[place3], kinds3[place3], p3[at3])
    return Shard(number, [code, code3, c3, c2], [_fixed(p4), _fixed(p3), escapes(total3, kinds3), escapes(total2, kinds2)])


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def shard_bits(shard: Shard, shards: int, pairs: np.ndarray, texts: list[str]) -> np.ndarray:
    """Fixed-point bits under each language of those bytes of each text whose context is the shard's."""
    data, starts = _codes(texts)
    width = pairs.shape[1]
    out = np.zeros((len(texts), width), np.int64)
    b = data.astype(np.int64)
    code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    keep = np.flatnonzero(_inside(len(code), starts))
    if shards > 1:
        keep = keep[shard_of(code[keep] >> 8 & 0xFFFF, shards) == shard.number]
    text = np.searchsorted(starts, keep, "right") - 1
    common = _fixed(pairs)
    for lo in range(0, len(keep), max(1, STEP // width)):
        hi = lo + max(1, STEP // width)
        run, of = code[keep[lo:hi]], text[lo:hi]
        if len(shard.keys[0]):
            at, hit = _found(shard.keys[0], run)
            bits = shard.bits[0][at].astype(np.int32)
            miss = np.flatnonzero(~hit)
            bits[miss] = 0
            at, hit = _found(shard.keys[2], run[miss] >> 8)
            bits[miss] += np.where(hit[:, None], shard.bits[2][at], 0)
            at, hit = _found(shard.keys[1], run[miss] & 0xFFFFFF)
            bits[miss[hit]] += shard.bits[1][at[hit]]
            miss = miss[~hit]
            at, hit = _found(shard.keys[3], run[miss] >> 8 & 0xFFFF)
            bits[miss] += np.where(hit[:, None], shard.bits[3][at], 0)
            bits[miss] += common[run[miss] & 0xFFFF]
        else:
            bits = common[run & 0xFFFF].astype(np.int32)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return out


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Fixed-point bits of each text under each language."""
    return sum(shard_bits(model.shard(k), model.shards, model.pairs, texts) for k in range(model.shards))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score``: the posterior share of that language under equal priors."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    context, shards, width = docs.sparkSession.sparkContext, model.shards, len(model.languages)
    bits, row = free_names(docs, "bits", "row")

    def summed(number: int):
        shard = model.shard(number)
        held = context.broadcast((shard.number, shard.keys, shard.bits, model.pairs))

        @F.pandas_udf("array<long>")
        def bits_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            *parts, pairs = held.value
            shard = Shard(*parts)
            for texts in batches:
                out = np.full(len(texts), None, object)
                known = np.flatnonzero([has_letter(t) for t in texts])
                if len(known):
                    for i, row_bits in zip(known, shard_bits(shard, shards, pairs, texts.iloc[known].tolist())):
                        out[i] = row_bits
                yield pd.Series(out)

        return bits_of("text")

    if shards == 1:
        coded = docs.withColumn(bits, summed(0))
    else:  # a text's bits are summed over the shards, each held alone
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        parts = None
        for number in range(shards):
            part = stored(rows.select(row, summed(number).alias(bits)), "bits")
            parts = part if parts is None else parts.unionByName(part)
        total = F.array(*[F.sum(F.get(bits, i)) for i in range(width)])
        coded = rows.join(parts.groupBy(row).agg(F.when(F.max(F.size(bits)) > 0, total).alias(bits)), row).drop(row)
    least = F.array_min(bits)
    share = F.aggregate(bits, F.lit(0.0), lambda acc, b: acc + F.pow(F.lit(2.0), -F.least((b - least) / BITS, F.lit(1000.0))))
    names = F.array(*[F.lit(x) for x in model.languages])
    return coded.withColumns({
        "lang_pred": F.when(F.col(bits).isNull(), UNKNOWN).otherwise(F.element_at(names, F.array_position(bits, least).cast("int"))),
        "score": F.coalesce(1 / share, F.lit(0.0))}).drop(bits)
