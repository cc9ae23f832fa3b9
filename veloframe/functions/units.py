"""Unit conversions on double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_MILE = 5280 * 12 * 2.54 / 100   # 1609.344
INCHES_PER_MM = 0.039                      # fixed value: the rounded factor in use


def miles(metres: Column) -> Column:
    return metres / F.lit(METRES_PER_MILE)


def kilometres(metres: Column) -> Column:
    return metres / F.lit(1000.0)


def mph(distance_miles: Column, seconds: Column) -> Column:
    """Miles per hour; a zero duration gives NULL instead of an ANSI error."""
    return F.try_divide(distance_miles, seconds / F.lit(3600.0))


def inches(mm: Column) -> Column:
    return mm * F.lit(INCHES_PER_MM)


def kmh(metres_per_second: Column) -> Column:
    return metres_per_second * F.lit(3.6)


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)
