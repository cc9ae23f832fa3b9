"""Bikes: activity, next pick-up and rebalancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefns
from .conform import station_role
from .sequence import with_next


def daily_unique_bikes(trips: DataFrame) -> DataFrame:
    return trips.select(F.to_date("start_time").alias("date"), "bike_id").distinct()


def daily_bike_count(unique_bikes: DataFrame) -> DataFrame:
    return unique_bikes.groupBy("date").agg(F.count("*").alias("total_bikes"))


def calendar(spark, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date"))


def trailing_distinct(pairs: DataFrame, key: str, date: str, days: int = 28,
                      start: str = "2013-01-01", end: str = "2017-12-31",
                      name: str = "bikes") -> DataFrame:
    """Distinct keys seen in the trailing ``days`` days, for each calendar day.

    ``pairs`` is distinct in (key, date).  A sighting covers its own day up to
    the day before the key's next sighting, at most ``days`` days.  These spans
    never overlap for one key, so counting them per day is the distinct count:
    no range join, no distinct aggregate, and each task hands on one partial
    count per calendar day.
    """
    nxt = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    stop = F.least(F.date_add(F.col(date), days - 1), F.date_sub(nxt, 1),
                   F.lit(end).cast("date"))
    begin = F.greatest(F.col(date), F.lit(start).cast("date"))
    spans = (pairs.where(F.col(key).isNotNull() & F.col(date).isNotNull())
             .select(begin.alias("_from"), stop.alias("_to"))
             .where(F.col("_from") <= F.col("_to")))
    return (spans.select(F.explode(F.sequence("_from", "_to")).alias("date"))
            .groupBy("date").agg(F.count("*").alias(name)))


def bike_chain(trips: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Each trip with the same bike's next start station and time.

    The last trip of a bike (or one followed by an unknown station) is dropped.
    Trips without a start time come first; equal start times are ordered by trip id.
    Each bike's trips are worked on in slices of ``slice_seconds``.
    """
    day = F.unix_date(F.to_date("start_time")).cast("long") * 86400
    second = day + F.hour("start_time") * 3600 + F.minute("start_time") * 60 + F.second("start_time")
    chained = with_next(
        trips.select("id", "bike_id", "start_time", "stop_time", "start_station_id", "end_station_id"),
        by=["bike_id"], order=["start_time", "id", "start_station_id", "end_station_id"],
        take={"next_start_station_id": "start_station_id", "next_start_time": "start_time"},
        slice_of=F.floor(second / slice_seconds))
    return (chained.where(F.col("next_start_station_id").isNotNull())
            .select("id", "bike_id", "start_time", "stop_time", "end_station_id",
                    "next_start_station_id", "next_start_time"))


def transport_counts(chain: DataFrame, period: str | None = None) -> DataFrame:
    """Drop-offs per end station (and month or hour), and how many of them were
    followed by a pick-up elsewhere."""
    ts = F.col("stop_time")
    extra = {"month": [timefns.month_start(ts).alias("month")],
             "hour": [F.hour(ts).alias("hour")], None: []}[period]
    moved = (F.col("end_station_id") != F.col("next_start_station_id")).cast("bigint")
    return (chain.groupBy(*extra, "end_station_id")
            .agg(F.count("*").alias("total_drop_offs"),
                 F.sum(moved).alias("transported_to_other_station")))


def transport_rate(counts: DataFrame, by: Sequence[str] = (), stations: DataFrame | None = None,
                   min_total: int | None = None) -> DataFrame:
    """Moved bikes per drop-off, by month, area, hour or overall."""
    if stations is not None:
        area = station_role(stations, "end", ["commarea"]).withColumnRenamed("end_commarea", "commarea")
        counts = counts.join(area, "end_station_id")
    out = counts.groupBy(*by).agg(
        (F.sum("transported_to_other_station") / F.sum("total_drop_offs")).alias("perc"),
        F.sum("total_drop_offs").alias("total"))
    return out if min_total is None else out.where(F.col("total") > min_total)
