"""Helpers shared by the operators of this package: stored tables, words, folds, hashing."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.session import checkpoint_folder

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BREAK_PATTERN = r"[\x20\x09-\x0D]+"
CACHE_WORDS = 200_000  # entries after which a task's cache of word hashes starts anew
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SMALL_ROWS = 100_000  # of a side that may be broadcast
SALTS = 16


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches that reach Python: whole texts are long, so few rows a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder of the session."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it from there.

    It cuts the lineage, survives lost executors, and keeps columns and statistics, so that later
    readers take only what they need.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.checkpoint_path = path  # for ``discard``
    return table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def joined_small(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join to a side with one row a key: broadcast up to ``limit`` rows (``SMALL_ROWS``), else repeated for each of
    ``SALTS`` salts, so that a hot key of ``rows`` goes to as many tasks."""
    limit = SMALL_ROWS if limit is None else limit
    if side.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(side), keys, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def words_of(text: Column) -> Column:
    """The words of a text, in order: maximal runs without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK_PATTERN), lambda w: w != "")


def fold_is(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(key as text) mod ``modulus`` is ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder,
                      F.lit(False))


class WordHashes(dict):
    """64-bit hash of a word given as bytes, kept for the next time; bounded by ``fresh``."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def fresh(self) -> WordHashes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return self

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can serve as a bucket."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` consecutive values; one hash of all when there are fewer."""
    if len(h) < n:
        n = len(h)
    total = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        total = total * MULTIPLIER + h[i: len(h) - n + 1 + i]
    return mixed(total)
