"""Staging to warehouse: stations, trips, the denormalised view, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, timefns
from ..functions.holidays import HOLIDAYS, RUSH_HOURS
from ..session import saved
from .sequence import with_dense_index


def build_stations(raw: DataFrame) -> DataFrame:
    """Distinct (external id, name, latitude, longitude), coordinates to 6 digits."""
    return raw.select(
        F.col("station_id").alias("external_id"), F.col("station_name").alias("name"),
        F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude")).distinct()


def with_station_ids(stations: DataFrame, ids_per_bucket: int = 1024) -> DataFrame:
    """Surrogate ids 1..n in (external id, position, name) order.  The stations are saved
    first: numbering reads them more than once."""
    return with_dense_index(
        saved(stations, "stations"), ["external_id", "latitude", "longitude", "name"],
        F.floor(F.col("external_id") / F.lit(ids_per_bucket)), name="id")


def conform_trips(raw: DataFrame, stations: DataFrame) -> DataFrame:
    """Replace external station ids by surrogate ones at both ends.

    Trips with an unknown station drop; an external id with two positions yields
    one trip per position, so (id, start_station_id, end_station_id) is the key.
    No join hint: a station table below the broadcast threshold is broadcast by
    Spark from its file size, a larger one is shuffled with skew handling.
    """
    start = stations.select(F.col("external_id").alias("start_station_id"),
                            F.col("id").alias("_start"))
    end = stations.select(F.col("external_id").alias("end_station_id"),
                          F.col("id").alias("_end"))
    return (raw.join(start, "start_station_id").join(end, "end_station_id")
            .select(F.col("trip_id").alias("id"), "trip_duration", "start_time", "stop_time",
                    F.col("_start").alias("start_station_id"),
                    F.col("_end").alias("end_station_id"),
                    F.col("bike_id").cast("bigint").alias("bike_id"), "user_type",
                    cleaning.clean_birth_year(F.col("birth_year")).alias("birth_year"), "gender"))


def unmatched_trips(raw: DataFrame, stations: DataFrame) -> DataFrame:
    """How many raw trips the two station joins drop."""
    known = stations.select(F.col("external_id").alias("_known")).distinct()
    start = known.withColumnRenamed("_known", "start_station_id")
    end = known.withColumnRenamed("_known", "end_station_id")
    hit = F.coalesce(F.col("_s"), F.lit(False)) & F.coalesce(F.col("_e"), F.lit(False))
    return (raw.select("start_station_id", "end_station_id")
            .join(start.withColumn("_s", F.lit(True)), "start_station_id", "left")
            .join(end.withColumn("_e", F.lit(True)), "end_station_id", "left")
            .agg(F.count("*").alias("trips"),
                 F.sum((~hit).cast("bigint")).alias("unmatched")))


STATION_ATTRIBUTES = {"name": "station_name", "latitude": "station_latitude",
                      "longitude": "station_longitude", "chict2010_gid": "chict2010_gid",
                      "commarea": "commarea", "commid": "commid"}


def station_role(stations: DataFrame, role: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The station table seen from one end of a trip, columns prefixed."""
    wanted = [c for c in (columns or STATION_ATTRIBUTES) if c in stations.columns]
    return stations.select(F.col("id").alias(f"{role}_station_id"),
                           *[F.col(c).alias(f"{role}_{STATION_ATTRIBUTES[c]}") for c in wanted])


def trips_and_stations(trips: DataFrame, stations: DataFrame) -> DataFrame:
    out = (trips.join(station_role(stations, "start"), "start_station_id")
           .join(station_role(stations, "end"), "end_station_id"))
    added = [c for c in out.columns if c not in trips.columns]
    return out.select(*trips.columns, *added)


def fill_if_null(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill missing values of ``columns`` from ``lookup`` (one row per key)."""
    other = lookup.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return df.join(other, key, "left").select(*[
        F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in columns else F.col(c)
        for c in df.columns])


# --- row filters -----------------------------------------------------------

def known_subscribers(trips: DataFrame, lo: int = 1940, hi: int = 2005) -> DataFrame:
    return trips.where((F.col("user_type") == "Subscriber") & F.col("gender").isNotNull()
                       & F.col("birth_year").between(lo, hi))


def not_round_trip(trips: DataFrame) -> DataFrame:
    return trips.where(F.col("start_station_id") != F.col("end_station_id"))


def not_dependent(trips: DataFrame) -> DataFrame:
    return trips.where(F.col("user_type") != "Dependent")


def exclude_holidays(df: DataFrame, ts: str, holidays: Sequence[str] | DataFrame = HOLIDAYS,
                     by_date: bool = False) -> DataFrame:
    """Drop holiday rows.

    The literal form compares the timestamp with midnight of each date, so it
    only drops starts at exactly 00:00; ``by_date=True`` drops the whole day.
    ``holidays`` may be a list or a DataFrame with a ``date`` column.
    """
    key = F.to_date(F.col(ts)) if by_date else F.col(ts)
    kind = "date" if by_date else "timestamp_ntz"
    if isinstance(holidays, DataFrame):
        days = holidays.select(F.col("date").cast(kind).alias("_day"))
        return df.join(days, key == F.col("_day"), "left_anti").where(F.col(ts).isNotNull())
    return df.where(~key.isin(*[F.lit(d).cast(kind) for d in holidays]))


def is_holiday(date: Column, holidays: Sequence[str] = HOLIDAYS) -> Column:
    return date.isin(*[F.lit(d).cast("date") for d in holidays])


def with_holiday(df: DataFrame, date: str = "date", holidays: Sequence[str] | DataFrame = HOLIDAYS,
                 name: str = "holiday") -> DataFrame:
    """Add whether the date is a holiday; NULL for a NULL date.

    ``holidays`` may be a list or a DataFrame with a ``date`` column, joined on the date.
    """
    if not isinstance(holidays, DataFrame):
        return df.withColumn(name, is_holiday(F.col(date), holidays))
    days = holidays.select(F.col("date").cast("date").alias("_holiday")).where("_holiday is not null").distinct()
    flag = F.when(F.col(date).isNotNull(), F.col("_holiday").isNotNull())
    return df.join(days, F.col(date) == F.col("_holiday"), "left").withColumn(name, flag).drop("_holiday")


def weekday_not_holiday(df: DataFrame, date: str = "date",
                        holidays: Sequence[str] | DataFrame = HOLIDAYS) -> DataFrame:
    day = timefns.is_weekday(F.col(date))
    return (with_holiday(df.withColumn("weekday", day), date, holidays, "_day_off")
            .withColumn("weekday_not_holiday", day & ~F.col("_day_off")).drop("_day_off"))


def rush_hour_weekdays(trips: DataFrame, hours: Sequence[int] = RUSH_HOURS) -> DataFrame:
    ts = F.col("start_time")
    return trips.where(timefns.in_hours(ts, hours) & timefns.is_weekday(ts))


def trim(df: DataFrame, value: str, lo: float, hi: float, closed: bool = True) -> DataFrame:
    v = F.col(value)
    return df.where(v.between(lo, hi) if closed else (v > lo) & (v < hi))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def in_bbox(df: DataFrame, lon: str, lat: str, west: float, south: float, east: float,
            north: float) -> DataFrame:
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def union_tagged(parts: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    """Stack frames, each marked with its name; missing columns become NULL."""
    out = None
    for name, part in parts.items():
        marked = part.withColumn(tag, F.lit(name))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out
