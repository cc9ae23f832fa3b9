"""Bikes, and order-based operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloframe.operators import fleet, flows, sequence, stats, weather

from . import fixtures as fx
from .base import register
from .fixtures import HOLIDAYS

register("daily_unique_bikes", lambda s, d: fleet.daily_unique_bikes(fx.trips(s, d)),
         "SELECT DISTINCT CAST(start_time AS DATE) AS date, bike_id FROM trips", ["trips"])
register("daily_bike_count", lambda s, d: fleet.daily_bike_count(
    fleet.daily_unique_bikes(fx.trips(s, d))),
    """SELECT CAST(start_time AS DATE) AS date, count(DISTINCT bike_id) AS total_bikes
FROM trips GROUP BY 1""", ["trips"])
ACTIVE = """SELECT d.date, count(DISTINCT b.bike_id) AS bikes
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{lo}', TIMESTAMP '{hi}', INTERVAL 1 DAY)) AS DATE)
  AS date) d, daily_shipments b
WHERE b.date <= d.date AND b.date >= d.date - 27 GROUP BY 1"""
register("active_bikes_28d", lambda s, d: fleet.trailing_distinct(
    fx.daily_shipments(s, d), "bike_id", "date", 28, "1995-01-01", "2001-12-31"),
    ACTIVE.format(lo="1995-01-01", hi="2001-12-31"), ["daily_shipments"])
register("trailing_range_join", lambda s, d: fleet.trailing_distinct(
    fleet.daily_unique_bikes(fx.trips(s, d)), "bike_id", "date", 7, "2024-01-03", "2024-02-15"),
    """SELECT d.date, count(DISTINCT b.bike_id) AS bikes
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-02-15',
  INTERVAL 1 DAY)) AS DATE) AS date) d,
  (SELECT DISTINCT CAST(start_time AS DATE) AS date, bike_id FROM trips) b
WHERE b.date <= d.date AND b.date >= d.date - 6 GROUP BY 1""", ["trips"])
register("calendar", lambda s, d: fleet.calendar(s, "2013-01-01", "2017-12-31").join(
    flows.daily_trips(fx.trips(s, d).withColumn("start_time", F.expr("start_time - interval '8' year"))),
    "date", "left"),
    """SELECT d.date, t.trips
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2013-01-01', TIMESTAMP '2017-12-31',
  INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN (SELECT CAST(start_time - INTERVAL 8 YEAR AS DATE) AS date, count(*) AS trips
  FROM trips GROUP BY 1) t ON d.date = t.date""", ["trips"])


def chain(s, d, slice_seconds=3600):
    return fleet.bike_chain(fx.trips(s, d), slice_seconds)


register("bike_chain", chain, "SELECT * FROM chain", ["chain"])
register("bike_chain_hot", lambda s, d: chain(s, d, slice_seconds=60), "SELECT * FROM chain", ["chain"])
# A third of all trips on one bike, some without a start time, and starts cut to the day, so that many tie.
HOT_BIKE = "CASE WHEN id % 3 = 0 THEN 0 ELSE bike_id END"
DAY_START = "CASE WHEN id % 7 <> 0 THEN date_trunc('day', start_time) END"
register("bike_chain_null_starts", lambda s, d: fleet.bike_chain(
    fx.trips(s, d).withColumn("bike_id", F.expr(HOT_BIKE))
    .withColumn("start_time", F.expr(DAY_START).cast("timestamp_ntz"))).drop("stop_time"),
    f"""SELECT id, bike_id, start_time, end_station_id, next_start_station_id, next_start_time FROM (
SELECT id, bike_id, start_time, end_station_id, lead(start_station_id) OVER w AS next_start_station_id,
  lead(start_time) OVER w AS next_start_time
FROM (SELECT id, {HOT_BIKE} AS bike_id, CAST({DAY_START} AS TIMESTAMP) AS start_time, start_station_id, end_station_id FROM trips)
WINDOW w AS (PARTITION BY bike_id ORDER BY start_time NULLS FIRST, id, start_station_id, end_station_id))
WHERE next_start_station_id IS NOT NULL""", ["trips"])
register("drop_last_event", lambda s, d: chain(s, d).groupBy("bike_id").agg(F.count("*").alias("kept")),
         "SELECT bike_id, count(*) AS kept FROM chain GROUP BY 1", ["chain"])
register("station_transport", lambda s, d: fleet.transport_counts(chain(s, d)),
         "SELECT * FROM transport_all", ["transport_all"])
register("monthly_station_transport", lambda s, d: fleet.transport_counts(chain(s, d), "month"),
         "SELECT * FROM transport_month", ["transport_month"])
register("hourly_station_transport", lambda s, d: fleet.transport_counts(chain(s, d), "hour"),
         "SELECT * FROM transport_hour", ["transport_hour"])
RATE = """SELECT {by}CAST(sum(transported_to_other_station) AS DOUBLE) / sum(total_drop_offs) AS perc,
  CAST(sum(total_drop_offs) AS BIGINT) AS total
FROM transport_{src} t {join} {tail}"""
AREA = "JOIN stations s ON t.end_station_id = s.id"


def by_area_hour(s, d, min_total):
    return stats.ranked(fleet.transport_rate(
        fleet.transport_counts(chain(s, d), "hour"), ["commarea", "hour"], fx.stations(s, d), min_total),
        ["commarea", "hour"], ascending=True)


def flagship(s, d, min_total=75):
    """Share of bikes moved between drop-off and next pick-up, by area and hour."""
    return by_area_hour(s, d, min_total)


register("transport_by_area_hour", flagship, RATE.format(
    by="commarea, hour, ", src="hour", join=AREA,
    tail="GROUP BY commarea, hour HAVING sum(total_drop_offs) > 75 ORDER BY commarea, hour"),
    ["transport_hour", "stations"], ["perc"])
register("transport_by_area_hour_1000", lambda s, d: by_area_hour(s, d, 85), RATE.format(
    by="commarea, hour, ", src="hour", join=AREA,
    tail="GROUP BY commarea, hour HAVING sum(total_drop_offs) > 85"),
    ["transport_hour", "stations"], ["perc"])
register("transport_area_join", lambda s, d: fleet.transport_counts(chain(s, d), "hour").join(
    fx.stations(s, d).select(F.col("id").alias("end_station_id"), "commarea"), "end_station_id"),
    "SELECT t.*, commarea FROM transport_hour t JOIN stations s ON t.end_station_id = s.id",
    ["transport_hour", "stations"])
register("monthly_transport_rate", lambda s, d: fleet.transport_rate(
    fleet.transport_counts(chain(s, d), "month"), ["month"]),
    RATE.format(by="month, ", src="month", join="", tail="GROUP BY month"), ["transport_month"], ["perc"])
register("overall_transport_rate", lambda s, d: fleet.transport_rate(fleet.transport_counts(chain(s, d))),
         RATE.format(by="", src="all", join="", tail=""), ["transport_all"], ["perc"])
register("transport_by_area", lambda s, d: stats.ranked(fleet.transport_rate(
    fleet.transport_counts(chain(s, d)), ["commarea"], fx.stations(s, d)), ["perc"], ["commarea"]),
    RATE.format(by="commarea, ", src="all", join=AREA, tail="GROUP BY commarea"),
    ["transport_all", "stations"], ["perc"])

register("rolling_28_rows", lambda s, d: sequence.rolling_sum(
    fx.daily_orders(s, d), "date", "trips", 28, F.trunc("date", "year"), "monthly_trips"),
    """SELECT date, trips, CASE WHEN row_number() OVER (ORDER BY date) >= 28 THEN
  CAST(sum(trips) OVER (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS BIGINT)
  END AS monthly_trips FROM daily_orders""", ["daily_orders"])


def generation(s, d):
    return flows.station_generation(flows.station_pair_daily(fx.trips(s, d), HOLIDAYS), ["date", "weekday"])


LAG = """SELECT *, log10(total_trips) AS log_total_trips, lag(total_trips) OVER w AS lag_total_trips,
  log10(lag(total_trips) OVER w) AS lag_log_total_trips FROM generation
WINDOW w AS (PARTITION BY {by} ORDER BY {order})"""
register("lag_generation", lambda s, d: weather.with_lag_generation(generation(s, d)),
         LAG.format(by="date, weekday", order="start_station_id"), ["generation"],
         ["log_total_trips", "lag_log_total_trips"])
register("lag_generation_intended",
         lambda s, d: weather.with_lag_generation(generation(s, d), across_stations=False),
         LAG.format(by="start_station_id", order="date"), ["generation"],
         ["log_total_trips", "lag_log_total_trips"])
