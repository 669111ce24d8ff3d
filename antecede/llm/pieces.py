"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

A text is cut at its spaces; each word, with the word mark in front, has a lattice of vocabulary
pieces. Forward filtering sums the weights of all ways to reach each position; backward sampling
walks from the end, choosing each piece with its posterior probability. The random numbers are a
hash of row key, word number and step, so a row is segmented alike in any batch or partition. Characters
without a piece, and the word mark itself where a text holds it, fall back to byte pieces, so decoding gives
the text back.

The vocabulary file holds merge ranks, not probabilities; a piece's weight is 1 / (rank + 1).

Batches are worked on as flat arrays: substrings are looked up by rolling hash, positions are filtered
over all different words at once, and all words are walked back together. Memory is bounded by the
batch, of which a text is never split.

Defined results: a null text gives null ids and null text; an empty text gives no ids. Rows repeating both key
and text are sampled alike. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import MULTIPLIER, mixed, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS_AT_ONCE = 400_000  # words of a batch that are sampled together
CHARS_AT_ONCE = 2_000_000  # characters whose lattices are held together


class Vocabulary:
    """Pieces by rolling hash, their weights, and byte pieces."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=proto)
        self.bytes_of: list[bytes] = []
        pieces = {}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if MARK not in piece[1:]:
                    pieces[piece] = i
        self.longest = max(map(len, pieces))
        self.by_size = []
        for size in range(1, self.longest + 1):
            chosen = [p for p in pieces if len(p) == size]
            heads = {p[:size] for p in pieces if len(p) > size}
            self.by_size.append((*self._sorted(chosen, pieces), np.sort(self._hashes(sorted(heads), size))))
        self.weight = -np.log(np.arange(1, len(self.bytes_of) + 1, dtype=np.float64))
        self.byte_weight = self.weight[-1]

    @staticmethod
    def _hashes(strings: list[str], size: int) -> np.ndarray:
        if not strings:
            return np.zeros(0, np.uint64)
        chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
        h = np.zeros(len(strings), np.uint64)
        for k in range(size):
            h = h * MULTIPLIER + chars[:, k] + np.uint64(1)
        return h

    def _sorted(self, strings: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes(strings, len(strings[0]) if strings else 1)
        order = np.argsort(h)
        return h[order], np.array([ids[s] for s in strings], np.int64)[order]


@lru_cache(maxsize=2)
def _vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def _found(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``h`` in the sorted hashes, and which are really there."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


class Lattices:
    """Lattices of different words, as edges sorted by their end position."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        v = vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = "".join(MARK + w for w in words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.ends = self.starts + sizes  # a word's positions are starts .. ends, shifted by its number
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(self.ends, sizes) - np.arange(len(chars))
        mark = (chars == np.uint64(ord(MARK)))
        mark[self.starts] = False
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        begin, size_of, piece = [], [], []
        for size in range(1, v.longest + 1):
            alive = left[at] >= size
            at, h = at[alive], h[alive]
            if not len(at):
                break
            h = h * MULTIPLIER + chars[at + size - 1] + np.uint64(1)
            alive = ~mark[at + size - 1]
            at, h = at[alive], h[alive]
            place, there = _found(v.by_size[size - 1][0], h)
            begin.append(at[there])
            size_of.append(np.full(there.sum(), size))
            piece.append(v.by_size[size - 1][1][place[there]])
            if size == 1:
                single = np.zeros(len(chars), bool)
                single[at[there]] = True
            _, there = _found(v.by_size[size - 1][2], h)
            at, h = at[there], h[there]
        lone = np.flatnonzero(~single)
        self.lone_bytes = [text[i].encode("utf-8", "surrogatepass") for i in lone.tolist()]
        begin.append(lone)
        size_of.append(np.ones(len(lone), np.int64))
        piece.append(-1 - np.arange(len(lone)))
        begin, size_of, piece = map(np.concatenate, (begin, size_of, piece))
        weight = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], 0.0)
        if len(lone):
            n_bytes = np.array([len(b) for b in self.lone_bytes])
            weight[piece < 0] = v.byte_weight * n_bytes[-1 - piece[piece < 0]]
        end = begin + size_of
        # Position p of word w is p + w, so that the end of a word and the start of the next differ.
        begin, end = begin + word[begin], end + word[begin]
        order = np.argsort(end, kind="stable")
        self.begin, self.end, self.piece, weight = begin[order], end[order], piece[order], weight[order]
        self.starts, self.ends = self.starts + np.arange(len(words)), self.ends + np.arange(len(words))
        self._filter(weight, sizes)

    def _filter(self, weight: np.ndarray, sizes: np.ndarray) -> None:
        """Posterior share of every edge among those that end where it ends."""
        n = int(self.ends[-1]) + 1
        first = np.searchsorted(self.end, np.arange(n + 1))
        total = np.zeros(n)
        self.share = np.zeros(len(weight))
        order = np.argsort(-sizes, kind="stable")
        ordered = sizes[order]
        for step in range(1, int(ordered[0]) + 1):
            ends = self.starts[order[: np.searchsorted(-ordered, -step, side="right")]] + step
            lo, counts = first[ends], first[ends + 1] - first[ends]
            group = np.concatenate([[0], np.cumsum(counts)[:-1]])
            e = np.arange(counts.sum()) + np.repeat(lo - group, counts)
            score = total[self.begin[e]] + weight[e]
            top = np.maximum.reduceat(score, group)
            p = np.exp(score - np.repeat(top, counts))
            mass = np.add.reduceat(p, group)
            total[ends] = top + np.log(mass)
            self.share[e] = p / np.repeat(mass, counts)
        upto = np.cumsum(self.share)
        base = np.concatenate([[0.0], upto])[first[self.end]]
        self.mark = self.end + np.minimum(upto - base, 1.0 - 1e-9)
        last = np.flatnonzero(np.diff(self.end, append=self.end[-1] + 1))
        self.mark[last] = self.end[last] + 1.0 - 1e-9

    def sampled(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, occurrence) in reading order for occurrences of the words with their seeds."""
        at, who, edges, owners = self.ends[word], np.arange(len(word)), [], []
        goal, step = self.starts[word], 0
        while len(who):
            u = mixed(seed[who] + np.uint64(step * int(MULTIPLIER) % (1 << 64))) >> np.uint64(11)
            u = u.astype(np.float64) * 2.0 ** -53 * (1 - 2e-9)
            e = np.searchsorted(self.mark, at + u)
            edges.append(e)
            owners.append(who)
            at = self.begin[e]
            alive = at > goal[who]
            at, who, step = at[alive], who[alive], step + 1
        edge, owner = np.concatenate(edges)[::-1], np.concatenate(owners)[::-1]
        order = np.argsort(owner, kind="stable")
        return edge[order], owner[order]


def encoded(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Sampled piece ids of each text; an empty text has none."""
    known: dict[str, int] = {}
    word_ids, lengths = [], []
    for text in texts:
        words = text.split(" ") if text else []
        word_ids.extend([known.setdefault(w, len(known)) for w in words])
        lengths.append(len(words))
    lengths = np.array(lengths, np.int64)
    if not word_ids:
        return [np.zeros(0, np.int64) for _ in texts]
    words = np.array(word_ids, np.int64)
    lattices = Lattices(list(known), vocabulary)
    number = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    seed = mixed(np.repeat(mixed(keys.astype(np.uint64)), lengths) + number.astype(np.uint64) * MULTIPLIER)
    parts = []
    for lo in range(0, len(words), WORDS_AT_ONCE):
        edge, owner = lattices.sampled(words[lo: lo + WORDS_AT_ONCE], seed[lo: lo + WORDS_AT_ONCE])
        parts.append((lattices.piece[edge], owner + lo))
    piece, owner = (np.concatenate(p) for p in zip(*parts))
    lone = np.flatnonzero(piece < 0)
    if len(lone):  # one byte piece per byte of the character
        data = [lattices.lone_bytes[-1 - p] for p in piece[lone].tolist()]
        counts = np.ones(len(piece), np.int64)
        counts[lone] = [len(b) for b in data]
        spread = np.repeat(piece, counts)
        spread[np.repeat(piece < 0, counts)] = vocabulary.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        piece, owner = spread, np.repeat(owner, counts)
    doc = np.repeat(np.arange(len(texts)), lengths)[owner]
    return np.split(piece, np.searchsorted(doc, np.arange(1, len(texts))))


def _in_parts(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    """``encoded`` over runs of texts of about CHARS_AT_ONCE characters, which bounds the flat arrays."""
    run = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE if texts else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return [ids for lo, hi in zip(cuts, cuts[1:]) for ids in encoded(texts[lo:hi], keys[lo:hi], vocabulary)]


def decoded(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of piece ids; the word mark of the first word is not part of it."""
    table = vocabulary.bytes_of
    return b"".join([table[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def with_pieces(df: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """Add ``piece_ids`` (array<int>) and ``decoded`` (text from those ids). ``model`` is read on the driver."""
    small_batches(df.sparkSession, 1000)
    with open(model, "rb") as f:
        proto = f.read()

    @F.pandas_udf("piece_ids array<int>, decoded string")
    def segment(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vocabulary = _vocabulary(proto)
        for keys, texts in batches:
            there = texts.notna()
            ids = _in_parts(texts[there].tolist(), keys[there].to_numpy(np.int64), vocabulary)
            out = pd.DataFrame({"piece_ids": None, "decoded": None}, index=texts.index, dtype=object)
            for row, i in zip(np.flatnonzero(there), ids):
                out.iat[row, 0], out.iat[row, 1] = i.astype(np.int32), decoded(i, vocabulary)
            yield out

    def seed(name: str) -> Column:
        return F.xxhash64(F.col(name).cast("string"))

    return df.withColumn("_p", segment(seed(key), F.col("text"))).withColumns(
        {"piece_ids": F.col("_p.piece_ids"), "decoded": F.col("_p.decoded")}).drop("_p")
