"""Counts by time, station pair and area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefns
from ..functions.holidays import HOLIDAYS
from .conform import not_round_trip, station_role, with_holiday


def daily_trips(trips: DataFrame) -> DataFrame:
    return (trips.groupBy(F.to_date("start_time").alias("date"))
            .agg(F.count("*").alias("trips")))


def station_pair_hourly(trips: DataFrame, weekdays_only: bool = False,
                        holidays: Sequence[str] | DataFrame = HOLIDAYS) -> DataFrame:
    """Trips by date, hour, start and end station, with a holiday flag.

    The summary every area flow below reads.  The literal form keeps weekends
    although published as a weekday table; ``weekdays_only`` gives the other.
    """
    ts = F.col("start_time")
    rows = trips.where(timefns.is_weekday(ts)) if weekdays_only else trips
    counts = (rows.groupBy(F.to_date(ts).alias("date"), F.hour(ts).alias("hour"),
                           "start_station_id", "end_station_id")
              .agg(F.count("*").alias("trips")))
    return with_holiday(counts, holidays=holidays)


def station_pair_daily(trips: DataFrame, holidays: Sequence[str] | DataFrame = HOLIDAYS) -> DataFrame:
    ts = F.col("start_time")
    counts = (trips.groupBy(F.to_date(ts).alias("date"), timefns.pg_dow(ts).alias("weekday"),
                            "start_station_id", "end_station_id")
              .agg(F.count("*").alias("trips")))
    return with_holiday(counts, holidays=holidays)


def pair_counts(trips: DataFrame) -> DataFrame:
    """Trips and distinct days per ordered station pair."""
    return (not_round_trip(trips).groupBy("start_station_id", "end_station_id")
            .agg(F.count("*").alias("count"),
                 F.countDistinct(F.to_date("start_time")).alias("num_days")))


def _with_areas(summary: DataFrame, stations: DataFrame, roles: Sequence[str]) -> DataFrame:
    for role in roles:
        summary = summary.join(station_role(stations, role, ["commarea"]), f"{role}_station_id")
    return summary


def area_flow(summary: DataFrame, stations: DataFrame, roles: Sequence[str] = ("start",),
              hours: tuple[int, int] | None = None, by_hour: bool = False) -> DataFrame:
    """Total trips, distinct days with a trip, and their ratio, by area.

    ``roles`` picks origin and/or destination areas, ``hours`` an inclusive
    range.  Input is the pair summary, so a busy station is already reduced to
    one row per date, hour and partner before the dimension join.
    """
    rows = summary.where(F.col("hour").between(*hours)) if hours else summary
    keys = (["hour"] if by_hour else []) + [f"{r}_commarea" for r in roles]
    return (_with_areas(rows, stations, roles).groupBy(*keys)
            .agg(F.sum("trips").alias("total"), F.countDistinct("date").alias("num_days"))
            .withColumn("avg", F.col("total") / F.col("num_days")))


def od_area_hourly(trips: DataFrame, stations: DataFrame,
                   roles: Sequence[str] = ("start", "end")) -> DataFrame:
    """Weekday trips by hour and area (pair)."""
    return area_flow(station_pair_hourly(trips, weekdays_only=True), stations, roles, by_hour=True)


def hour_profile(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trips, distinct days and trips per day by hour and weekday / weekend."""
    ts = F.col("start_time")
    return (trips.groupBy(F.hour(ts).alias("hour"), *by, timefns.weekday_label(ts).alias("dow"))
            .agg(F.count("*").alias("counts"), F.countDistinct(F.to_date(ts)).alias("num_days"))
            .withColumn("avg", F.col("counts") / F.col("num_days")))


def station_generation(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trips started per station, from a pair summary."""
    return (pairs.groupBy(*by, "start_station_id").agg(F.sum("trips").alias("total_trips")))


def station_block_generation(hourly: DataFrame, wraps: bool = False) -> DataFrame:
    rows = (hourly.withColumn("day_block", timefns.day_block(F.col("hour"), wraps))
            .withColumn("year", F.year("date")))
    return station_generation(rows, ["date", "day_block", "year"])


def station_flow(summary: DataFrame, stations: DataFrame, roles: Sequence[str],
                 hours: tuple[int, int], by_hour: bool = False) -> DataFrame:
    """Total and distinct days per station (or pair) with its position."""
    rows = summary.where(F.col("hour").between(*hours))
    keys = ["hour"] if by_hour else []
    for role in roles:
        place = stations.select(F.col("id").alias(f"{role}_station_id"),
                                F.col("latitude").alias(f"{role}_lat"),
                                F.col("longitude").alias(f"{role}_lon"))
        rows = rows.join(place, f"{role}_station_id")
        keys += [f"{role}_station_id", f"{role}_lat", f"{role}_lon"]
    return rows.groupBy(*keys).agg(F.sum("trips").alias("total"),
                                   F.countDistinct("date").alias("num_days"))


def area_flow_spatial(located: DataFrame, area: str) -> DataFrame:
    """Station flows summed per polygon: sum of totals over sum of station-days."""
    return (located.groupBy(area)
            .agg(F.sum("total").alias("counts"), F.sum("num_days").alias("total_days"))
            .withColumn("avg", F.col("counts") / F.col("total_days")))
