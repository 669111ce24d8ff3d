"""Day-number conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_of_day(day: Column) -> Column:
    """yyyymmdd integer to DATE."""
    return F.make_date(F.floor(day / 10000), F.floor(day / 100) % 100, day % 100)


def day_of_date(date: Column) -> Column:
    """DATE to yyyymmdd integer."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def day_number(date: Column) -> Column:
    """Days since 1970-01-01, for RANGE frames and bucket joins."""
    return F.unix_date(date)


def month_of_day(day: Column) -> Column:
    return F.floor(day / 100).cast("int")


def month_label(month: Column) -> Column:
    """yyyymm integer to ``YYYY-MM``."""
    text = month.cast("string")
    return F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2))
