"""From raw files to conformed tables and stored summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.holidays import HOLIDAYS
from ..operators import conform, fleet, flows, riders, spatial, weather
from ..sources import readers
from ..sources.writers import save_summary


def locate_stations(stations: DataFrame, tracts: DataFrame, communities: DataFrame) -> DataFrame:
    """Stations with tract id, community id and community name; values already
    there are kept."""
    point = stations.select("id", "longitude", "latitude")
    tract = (spatial.assign_area(point, tracts, "longitude", "latitude", "id")
             .withColumnRenamed("gid", "chict2010_gid"))
    area = (spatial.assign_area(point, communities, "longitude", "latitude", "id", "name")
            .withColumnRenamed("gid", "commid").withColumnRenamed("name", "commarea"))
    blank = {"chict2010_gid": "int", "commid": "int", "commarea": "string"}
    out = stations.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()
                                if c not in stations.columns})
    out = conform.fill_if_null(out, tract, "id", ["chict2010_gid"])
    return conform.fill_if_null(out, area, "id", ["commid", "commarea"])


def summaries(trips: DataFrame, chain: DataFrame, weather_days: DataFrame,
              holidays: Sequence[str] | DataFrame = HOLIDAYS, unique: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ten stored summaries, lazily.  ``chain`` is ``fleet.bike_chain(trips)`` and
    ``unique`` the daily unique bikes, saved by the caller because others read them."""
    unique = fleet.daily_unique_bikes(trips) if unique is None else unique
    return {
        "anon_hourly": riders.anon_counts(trips, "hour"),
        "anon_daily": riders.anon_counts(trips, "day"),
        "daily_agg_weather": weather.daily_weather(trips, weather_days, holidays),
        "weekday_sts_hourly": flows.station_pair_hourly(trips, holidays=holidays),
        "daily_unique_bike_ids": unique,
        "monthly_active_bikes": fleet.trailing_distinct(unique, "bike_id", "date"),
        "bike_station_ids": chain,
        "station_aggregates": fleet.transport_counts(chain),
        "monthly_station_aggregates": fleet.transport_counts(chain, "month"),
        "hourly_station_aggregates": fleet.transport_counts(chain, "hour"),
    }


def build_warehouse(spark: SparkSession, inputs: dict[str, str], out: str,
                    holidays: Sequence[str] | DataFrame = HOLIDAYS) -> dict[str, str]:
    """Read the raw files, conform, locate, and store every table below ``out``.

    ``inputs`` names the paths of trips, stations, weather, tracts and
    communities.  Trips are stored by start date, so date filters prune files.
    Returns the path of each table.
    """
    paths: dict[str, str] = {}

    def store(name: str, df: DataFrame, by: Sequence[str] = (), sort: Sequence[str] = ()) -> DataFrame:
        paths[name] = f"{out}/{name}"
        save_summary(df, paths[name], by, sort)
        return spark.read.parquet(paths[name])

    stations = conform.with_station_ids(conform.build_stations(readers.read_stations(spark, inputs["stations"])))
    stations = store("stations", locate_stations(
        stations, readers.read_boundaries(spark, inputs["tracts"]),
        readers.read_boundaries(spark, inputs["communities"])))
    days = store("chicago_weather_observations", readers.read_weather(spark, inputs["weather"]))
    raw = readers.read_trips(spark, inputs["trips"])
    trips = store("trips", conform.conform_trips(raw, stations)
                  .withColumn("start_date", F.to_date("start_time")), ["start_date"], ["start_time"])
    chain = store("bike_station_ids", fleet.bike_chain(trips))
    unique = store("daily_unique_bike_ids", fleet.daily_unique_bikes(trips))
    for name, df in summaries(trips, chain, days, holidays, unique).items():
        if name not in paths:
            store(name, df)
    return paths
