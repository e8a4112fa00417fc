"""Scalar expressions shared by the models, all of them built-in Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31 00:00:00"


def money(c: Column, digits: int = 2) -> Column:
    """Round half up on decimals, as a double, so that ties do not depend on binary fractions."""
    return F.round(c.cast("decimal(38,6)"), digits).cast("double")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def month_of(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("date")


def months_between(first: Column, later: Column) -> Column:
    """Whole calendar months, without regard to the day."""
    return ((F.year(later) - F.year(first)) * 12 + F.month(later) - F.month(first)).cast("int")


def surrogate(*parts: Column) -> Column:
    """md5 of the parts joined by '-'; null if any part is null."""
    text = parts[0].cast("string")
    for p in parts[1:]:
        text = F.concat(text, F.lit("-"), p.cast("string"))
    return F.md5(text)


def never_null(condition: Column) -> Column:
    """A condition that counts null as false."""
    return F.coalesce(condition, F.lit(False))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, null where the whole is 0."""
    return money(F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def hours_since(ts: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600.0
