"""Quality by hashed word n-grams and logistic regression, trained with FTRL-proximal updates.

Features of a text are its words, word pairs, and the same over word shapes, hashed into ``BUCKETS``; each
counts as its share of the text's words, so length does not matter. A score is the sparse dot product with the
weights, through the logistic function.

Training follows McMahan et al.: per-coordinate rates and L1, one row after another. The rows are a
sample of at most ``TRAIN_ROWS`` labelled documents, chosen from the labels by hash of the id, and run through one task;
this bound is the operator's documented parameter. Scoring covers every document.

Defined results: a null or empty text has no features and gets the bias alone; repeated rows score
alike; without labels every score is 0.5; extra columns pass through ``scored``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import MULTIPLIER, WordHashes, mixed, small_batches
from antecede.llm.toxicity import labelled

BUCKETS = 1 << 20
TRAIN_ROWS = 6000
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 30.0  # makes the shares of a text large enough for the rates above
SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


class _Pairs(dict):
    """Word -> (hash of the lower-cased word, hash of its shape), with a bounded number of entries."""

    def __init__(self):
        self.hashes = WordHashes()

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = word
        for pattern, mark in SHAPES:
            shape = pattern.sub(mark, shape)
        self[word] = value = (self.hashes[word.lower()], self.hashes[b"\0" + shape])
        return value


def buckets(text: str | None, hashes: _Pairs) -> np.ndarray:
    """Buckets of a text's features, with repeats."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    if len(hashes) > 200_000:
        hashes.clear()
        hashes.hashes.clear()
    both = np.array([hashes[w] for w in words], np.uint64)
    h = np.concatenate([both.ravel(), (both[:-1] * MULTIPLIER + both[1:] + np.uint64(1)).ravel()])
    return (mixed(h) >> np.uint64(44)).astype(np.int64) % BUCKETS


def _learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, rows = _Pairs(), []
    for batch in batches:
        for text, label in zip(batch["text"], batch["quality"]):
            index, count = np.unique(buckets(text, hashes), return_counts=True)
            rows.append((index.astype(np.int32), (SCALE * count / max(count.sum(), 1)).astype(np.float32), float(label)))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(ROUNDS):
        for index, value, label in rows:
            at, x = np.append(index, BUCKETS), np.append(value, 1.0)  # the last is the bias
            zi, ni = z[at], n[at]
            l1 = np.full(len(at), L1)
            l1[-1] = 0.0
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    yield pd.DataFrame({"bucket": at.astype(np.int64), "weight": w[at]})


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights by bucket, the bias last, from labelled documents."""
    small_batches(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # Ids may repeat, so the rows are bounded too: the first ones of each task meet in one.
    sample = labelled(docs, chosen, "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_ROWS)
    found = sample.select("text", "quality").mapInPandas(_learned, "bucket long, weight double").toPandas()
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[found["bucket"].to_numpy(np.int64)] = found["weight"]
    return weights


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Add ``score``, 0 to 1, to every document."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Pairs()
        w = held.value
        for texts in batches:
            total = np.empty(len(texts))
            for i, text in enumerate(texts):
                at = buckets(text, hashes)
                total[i] = w[-1] + (SCALE * w[at].sum(dtype=np.float64) / len(at) if len(at) else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    return docs.withColumn("score", score("text"))
