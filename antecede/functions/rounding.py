"""Rounding that does not hang on the last bit of a double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def steady_round(value: Column, digits: int) -> Column:
    """Round half away from zero after clearing binary noise at the tenth digit."""
    return F.round(F.round(value, 9), digits)
