"""Tokenisers and set similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop lists.
QUESTION_STOP = (
    "the a an of in on at to for and or by with from as its their his her this that these those "
    "who which was were is are be been has have had said says did does do why what how when where "
    "after over into against about news article html www com php"
)
MENTION_STOP = (
    "the a an of in on at to for and or by with from as its their his her this that these those "
    "who which was were is are be been has have had said says"
)


def stripped(text: Column) -> Column:
    """Text without white space at its ends, line breaks and tabs included."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def question_tokens(text: Column) -> Column:
    """Retrieval tokens: longer than two characters, no stop words, plural ``s`` cut."""
    stop = QUESTION_STOP.split()
    kept = F.filter(_words(text), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.transform(kept, lambda w: F.when(
        (F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def content_words(text: Column) -> Column:
    """Distinct words longer than three characters."""
    return F.array_distinct(F.filter(_words(text), lambda w: F.length(w) > 3))


def mention_words(text: Column) -> Column:
    """Distinct words longer than two characters, without stop words."""
    stop = MENTION_STOP.split()
    return F.array_distinct(F.filter(_words(text), lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def headline_words(text: Column) -> Column:
    """Distinct words longer than two characters."""
    return F.array_distinct(F.filter(_words(text), lambda w: F.length(w) > 2))


def known_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays; null when either is empty (unknown)."""
    both = F.size(F.array_intersect(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def texts_of(*arrays: Column) -> Column:
    """Several string arrays as one text."""
    return F.concat_ws(" ", *arrays)
