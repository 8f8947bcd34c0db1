"""Years without a year zero, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def historical(astronomical: Column) -> Column:
    """Astronomical years as BC-negative ones: 0 is -1, -1 is -2."""
    return F.when(astronomical <= 0, astronomical - 1).otherwise(astronomical)


def astronomical(year: Column) -> Column:
    return F.when(year < 0, year + 1).otherwise(year)


def duration(text: Column) -> Column:
    """Years in a text of parts such as 40Y6M2W3D; null if it has none."""
    parts = F.regexp_extract_all(text, F.lit(r"[0-9.]+[YMWD]"), F.lit(0))
    unit = lambda p: F.when(p.endswith("Y"), 1.0).when(p.endswith("M"), 1 / 12).when(p.endswith("W"), 7 / 365.25).otherwise(1 / 365.25)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.regexp_extract(p, "^[0-9.]+", 0).cast("double") * unit(p))
    return F.when(F.size(parts) > 0, total)


def end_year(start: Column, text: Column) -> Column:
    """Last year of a duration that begins in the historical year start."""
    return historical(F.floor(astronomical(start) + duration(text) + 1e-9).cast("int"))


def spelled(year: Column) -> Column:
    return F.when(year <= 0, F.concat(F.greatest(-year, F.lit(1)).cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), year.cast("string")))


def spelled_span(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low == high, spelled(low)).otherwise(F.concat(spelled(low), F.lit(" – "), spelled(high)))


def rotating(day: Column, items: Column) -> Column:
    """The item for a day of the year, in turn."""
    return F.element_at(items, F.pmod(day - 1, F.size(items)) + 1)


def ticks(low: Column, high: Column, step: int) -> Column:
    """Multiples of step within [low, high]."""
    first, last = F.ceil(low / step).cast("int") * step, F.floor(high / step).cast("int") * step
    return F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
