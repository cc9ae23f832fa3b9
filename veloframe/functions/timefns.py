"""Time columns with the warehouse's conventions.

All take TIMESTAMP_NTZ columns and stay in NTZ arithmetic, so results do not
depend on the session time zone (``date_trunc`` would go through LTZ).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .holidays import RUSH_HOURS


def pg_dow(ts: Column) -> Column:
    """Day of week, 0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def is_weekday(ts: Column) -> Column:
    return pg_dow(ts).between(1, 5)


def weekday_label(ts: Column) -> Column:
    return F.when(is_weekday(ts), "Weekdays").when(pg_dow(ts).isin(0, 6), "Weekends")


def in_hours(ts: Column, hours=RUSH_HOURS) -> Column:
    return F.hour(ts).isin(*hours)


def hour_between(ts: Column, lo: int, hi: int) -> Column:
    return F.hour(ts).between(lo, hi)


def round_to_hour(ts: Column) -> Column:
    """Nearest hour; half past rounds up."""
    shifted = ts + F.expr("INTERVAL '30' MINUTE")
    return F.timestamp_add("HOUR", F.hour(shifted), F.to_date(shifted).cast("timestamp_ntz"))


def round_to_day(ts: Column) -> Column:
    """Nearest day; noon rounds up."""
    return F.to_date(ts + F.expr("INTERVAL '12' HOUR")).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def axis_time(hour: Column) -> Column:
    """An hour of day as a timestamp on 1970-01-01."""
    return F.timestamp_add("HOUR", hour.cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))


def day_block(hour: Column, wraps: bool = False) -> Column:
    """Named block of the day.

    The literal overnight test (hour >= 23 and hour < 6) never holds, so those
    hours get NULL; ``wraps=True`` gives the block that was meant.
    """
    block = (F.when((hour >= 6) & (hour < 10), "peak_morn")
             .when((hour >= 10) & (hour < 14), "midday")
             .when((hour >= 14) & (hour < 18), "peak_aft")
             .when((hour >= 18) & (hour < 23), "even"))
    return block.when((hour >= 23) | (hour < 6), "overnight") if wraps else block
