"""Dates that may be partial, and dates in several formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats of full dates, tried in this order.
FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d")
PATTERNS = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$")


def partial_date(raw: Column) -> Column:
    """Y, Y/M or Y/M/D as (raw, year, month, day, precision 9 to 11), 0 for what is unknown; null if it is no such date."""
    parts = F.split(raw, "/")
    padded = F.concat(raw, F.repeat(F.lit("/1"), 3 - F.size(parts)))
    valid = raw.rlike(r"^\d{4}(/\d{1,2}){0,2}$") & F.try_to_date(padded, "yyyy/M/d").isNotNull()
    number = lambda i: F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0))
    return F.when(valid, F.struct(raw.alias("raw"), number(0).alias("year"), number(1).alias("month"), number(2).alias("day"), (8 + F.size(parts)).alias("precision")))


def parsed_date(raw: Column) -> Column:
    """The first of FORMATS that reads the whole text, else null."""
    return F.coalesce(*[F.when(raw.rlike(p), F.try_to_date(raw, f)) for f, p in zip(FORMATS, PATTERNS, strict=True)])


def published_utc(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local, zone)
