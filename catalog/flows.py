"""Joins, counts by time and place, and area flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloframe.operators import conform, flows, stats
from veloframe.operators.quantiles import quantiles, top_percentile
from veloframe.session import saved

from . import fixtures as fx
from .base import QUERIES, register
from .fixtures import HOLIDAYS


def hourly(s, d, weekdays_only=False):
    return flows.station_pair_hourly(fx.trips(s, d), weekdays_only, HOLIDAYS)


def od(s, d):
    return flows.od_area_hourly(fx.trips(s, d), fx.stations(s, d))


# --- conforming joins ---------------------------------------------------------
def raw_trips(s, d):
    t = fx.trips_staging(s, d)
    return t.select(F.col("id").alias("trip_id"), "trip_duration", "start_time", "stop_time",
                    (F.col("start_station_id") + 100).alias("start_station_id"),
                    (F.col("end_station_id") + 100).alias("end_station_id"),
                    F.col("bike_id").cast("double").alias("bike_id"), "user_type",
                    F.col("birth_year_raw").alias("birth_year"), "gender")


def two_site_stations(s, d):
    """External ids 101..124 (100 is unknown); those divisible by 7 have moved
    and so have two rows."""
    base = fx.stations(s, d).where(F.col("id") > 0)
    moves = F.when((F.col("id") + 100) % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (base.withColumn("site", F.explode(moves))
            .select((F.col("id") * 10 + F.col("site")).alias("id"),
                    (F.col("id") + 100).alias("external_id")))


TWO_SITE = """two_site AS (
  SELECT id * 10 + site AS id, id + 100 AS external_id
  FROM stations, (VALUES (0), (1)) v(site) WHERE id > 0 AND (site = 0 OR (id + 100) % 7 = 0))"""
fx.CTE["two_site"] = TWO_SITE
fx.NEEDS["two_site"] = ["stations"]

register("conform_trips", lambda s, d: conform.conform_trips(raw_trips(s, d), two_site_stations(s, d)),
         """SELECT t.id, trip_duration, start_time, stop_time, ss.id AS start_station_id,
  es.id AS end_station_id, bike_id, user_type, birth_year, gender
FROM trips t JOIN two_site ss ON t.start_station_id + 100 = ss.external_id
  JOIN two_site es ON t.end_station_id + 100 = es.external_id""", ["trips", "two_site"])
register("unmatched_trips", lambda s, d: conform.unmatched_trips(raw_trips(s, d), two_site_stations(s, d)),
         """SELECT count(*) AS trips, CAST(sum(CAST(start_station_id + 100 NOT IN
    (SELECT external_id FROM two_site) OR end_station_id + 100 NOT IN
    (SELECT external_id FROM two_site) AS INTEGER)) AS BIGINT) AS unmatched FROM trips""",
         ["trips", "two_site"])
register("trips_and_stations", lambda s, d: conform.trips_and_stations(fx.trips(s, d), fx.stations(s, d))
         .select("id", "start_time", "start_station_id", "end_station_id", "start_station_name",
                 "start_station_latitude", "start_station_longitude", "start_commarea",
                 "end_station_name", "end_station_latitude", "end_station_longitude", "end_commarea"),
         """SELECT t.id, start_time, start_station_id, end_station_id, ss.name AS start_station_name,
  ss.latitude AS start_station_latitude, ss.longitude AS start_station_longitude,
  ss.commarea AS start_commarea, es.name AS end_station_name,
  es.latitude AS end_station_latitude, es.longitude AS end_station_longitude,
  es.commarea AS end_commarea
FROM trips t JOIN stations ss ON t.start_station_id = ss.id
  JOIN stations es ON t.end_station_id = es.id""", ["trips", "stations"],
         ["start_station_latitude", "start_station_longitude", "end_station_latitude",
          "end_station_longitude"])

# --- counts by time -------------------------------------------------------------
register("daily_trips", lambda s, d: flows.daily_trips(fx.trips(s, d)),
         "SELECT CAST(start_time AS DATE) AS date, count(*) AS trips FROM trips GROUP BY 1", ["trips"])
register("station_pair_hourly", lambda s, d: hourly(s, d), "SELECT * FROM pairs_hourly", ["pairs_hourly"])
register("station_pair_hourly_intended", lambda s, d: hourly(s, d, True),
         "SELECT * FROM pairs_weekday", ["pairs_weekday"])
register("station_pair_daily", lambda s, d: flows.station_pair_daily(fx.trips(s, d), HOLIDAYS),
         "SELECT * FROM pairs_daily", ["pairs_daily"])
# The holidays as a table instead of a list.
register("station_pair_daily_holiday_table", lambda s, d: flows.station_pair_daily(
    fx.trips(s, d), s.createDataFrame([(h,) for h in fx.HOLIDAYS], "date string")),
    f"""SELECT CAST(start_time AS DATE) AS date, dayofweek(start_time) AS weekday, start_station_id, end_station_id,
  count(*) AS trips, CAST(start_time AS DATE) IN ({fx.HOLIDAY_SQL}) AS holiday FROM trips GROUP BY ALL""", ["trips"])
register("pair_counts", lambda s, d: flows.pair_counts(fx.trips(s, d)),
         "SELECT * FROM pair_counts", ["pair_counts"])
PROFILE = """SELECT hour(start_time) AS hour, {by}CASE WHEN dayofweek(start_time) IN (1, 2, 3, 4, 5)
  THEN 'Weekdays' WHEN dayofweek(start_time) IN (0, 6) THEN 'Weekends' END AS dow,
  count(*) AS counts, count(DISTINCT CAST(start_time AS DATE)) AS num_days,
  CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(start_time AS DATE)) AS avg
FROM trips {where}GROUP BY ALL"""
register("hour_by_daytype", lambda s, d: flows.hour_profile(fx.trips(s, d)),
         PROFILE.format(by="", where=""), ["trips"], ["avg"])
register("user_hour_by_daytype", lambda s, d: conform.not_dependent(
    flows.hour_profile(fx.trips(s, d), ["user_type"])),
    PROFILE.format(by="user_type, ", where="WHERE user_type != 'Dependent' "), ["trips"], ["avg"])
register("head_rows", lambda s, d: stats.head_rows(
    flows.hour_profile(fx.trips(s, d), ["user_type"])
    .where((F.col("user_type") == "Subscriber") & (F.col("dow") == "Weekdays")), 30, ["hour"]),
    PROFILE.format(by="user_type, ", where="WHERE user_type = 'Subscriber' "
                   "AND dayofweek(start_time) BETWEEN 1 AND 5 ") + " ORDER BY hour LIMIT 30",
    ["trips"], ["avg"])

# --- area flows -----------------------------------------------------------------
register("od_area_join", lambda s, d: flows._with_areas(
    hourly(s, d, True), fx.stations(s, d), ["start", "end"])
    .select("date", "hour", "start_commarea", "end_commarea", "trips"),
    """SELECT date, hour, ss.commarea AS start_commarea, es.commarea AS end_commarea, trips
FROM pairs_weekday JOIN stations ss ON ss.id = start_station_id
  JOIN stations es ON es.id = end_station_id""", ["pairs_weekday", "stations"])
register("station_area_join", lambda s, d: flows._with_areas(hourly(s, d), fx.stations(s, d), ["end"])
         .select("date", "hour", "start_station_id", "end_commarea", "trips"),
         """SELECT date, hour, start_station_id, es.commarea AS end_commarea, trips
FROM pairs_hourly w JOIN stations es ON w.end_station_id = es.id""", ["pairs_hourly", "stations"])
register("od_area_hourly", od, "SELECT * FROM od_hourly", ["od_hourly"], ["avg"])
register("origin_area_hourly", lambda s, d: flows.od_area_hourly(
    fx.trips(s, d), fx.stations(s, d), ["start"]),
    """SELECT hour, commarea AS start_commarea, CAST(sum(trips) AS BIGINT) AS total,
  count(DISTINCT date) AS num_days, CAST(sum(trips) AS DOUBLE) / count(DISTINCT date) AS avg
FROM pairs_weekday w JOIN stations ss ON w.start_station_id = ss.id GROUP BY ALL""",
    ["pairs_weekday", "stations"], ["avg"])

FLOW = """SELECT {hour}{cols}, CAST(sum(trips) AS BIGINT) AS total, count(DISTINCT date) AS num_days,
  CAST(sum(trips) AS DOUBLE) / count(DISTINCT date) AS avg
FROM {src} w {joins} WHERE hour BETWEEN {lo} AND {hi} GROUP BY ALL"""


def flow_sql(roles, lo, hi, src="pairs_hourly", hour=""):
    alias = {"start": "ss", "end": "es"}
    return FLOW.format(
        hour=hour, src=src, lo=lo, hi=hi,
        cols=", ".join(f"{alias[r]}.commarea AS {r}_commarea" for r in roles),
        joins=" ".join(f"JOIN stations {alias[r]} ON w.{r}_station_id = {alias[r]}.id" for r in roles))


for name, role, hours in (("morning_origin", "start", (6, 9)), ("morning_destination", "end", (6, 9)),
                          ("evening_origin", "start", (16, 19)), ("evening_destination", "end", (16, 19))):
    for suffix, weekdays in (("", False), ("_intended", True)):
        register(name + suffix, lambda s, d, role=role, hours=hours, weekdays=weekdays: stats.ranked(
            flows.area_flow(hourly(s, d, weekdays), fx.stations(s, d), [role], hours),
            ["avg"], [f"{role}_commarea"]),
            flow_sql([role], *hours, src="pairs_weekday" if weekdays else "pairs_hourly"),
            ["pairs_weekday", "stations"], ["avg"])
for name, hours in (("morning_od", (6, 9)), ("evening_od", (16, 19))):
    register(name, lambda s, d, hours=hours: stats.ranked(
        flows.area_flow(hourly(s, d), fx.stations(s, d), ["start", "end"], hours, by_hour=True),
        ["avg"], ["hour", "start_commarea", "end_commarea"]),
        flow_sql(["start", "end"], *hours, hour="hour, "), ["pairs_hourly", "stations"], ["avg"])

# --- generation and station flows -----------------------------------------------
register("station_day_generation", lambda s, d: flows.station_generation(
    flows.station_pair_daily(fx.trips(s, d), HOLIDAYS), ["date", "weekday"]),
    "SELECT * FROM generation", ["generation"])
register("station_hour_generation", lambda s, d: flows.station_generation(
    hourly(s, d), ["date", "hour"]),
    """SELECT date, hour, start_station_id, CAST(sum(trips) AS BIGINT) AS total_trips
FROM pairs_hourly GROUP BY ALL""", ["pairs_hourly"])
from .cleaning import BLOCK  # noqa: E402

for suffix, wraps, op in (("", False, "AND"), ("_intended", True, "OR")):
    register(f"station_block_generation{suffix}",
             lambda s, d, wraps=wraps: flows.station_block_generation(hourly(s, d), wraps),
             f"""SELECT date, {BLOCK.format(op=op)} AS day_block, year(date) AS year, start_station_id,
  CAST(sum(trips) AS BIGINT) AS total_trips FROM pairs_hourly GROUP BY ALL""", ["pairs_hourly"])


def station_flow_sql(roles, lo, hi, by_hour, src="pairs_hourly"):
    alias = {"start": "ss", "end": "es"}
    cols = (["hour"] if by_hour else [])
    for r in roles:
        cols += [f"w.{r}_station_id", f"{alias[r]}.latitude AS {r}_lat", f"{alias[r]}.longitude AS {r}_lon"]
    joins = " ".join(f"JOIN stations {alias[r]} ON w.{r}_station_id = {alias[r]}.id" for r in roles)
    return (f"SELECT {', '.join(cols)}, CAST(sum(trips) AS BIGINT) AS total, count(DISTINCT date) AS num_days "
            f"FROM {src} w {joins} WHERE hour BETWEEN {lo} AND {hi} GROUP BY ALL")


# The morning-origin and pair forms also group by hour.  The pair forms read the
# weekday pairs, the single-station ones the whole summary.
STATION_FLOWS = {
    "station_flow_coords": (("start", "end"), (6, 9), True, True),
    "station_flow_evening": (("start", "end"), (16, 19), True, True),
    "station_flow_morning_origin": (("start",), (6, 9), True, False),
    "station_flow_morning_destination": (("end",), (6, 9), False, False),
    "station_flow_evening_origin": (("start",), (16, 19), False, False),
    "station_flow_evening_destination": (("end",), (16, 19), False, False),
}
for name, (roles, hours, by_hour, weekdays) in STATION_FLOWS.items():
    register(name, lambda s, d, roles=roles, hours=hours, by_hour=by_hour, weekdays=weekdays:
             flows.station_flow(hourly(s, d, weekdays), fx.stations(s, d), roles, hours, by_hour),
             station_flow_sql(roles, *hours, by_hour, "pairs_weekday" if weekdays else "pairs_hourly"),
             ["pairs_weekday", "stations"], [f"{r}_{c}" for r in roles for c in ("lat", "lon")])

# --- quantiles, ranks, unions ------------------------------------------------------
PROBS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def quantile_sql(src, col, probs=PROBS, by=""):
    head = f"{by}, " if by else ""
    rows = " UNION ALL ".join(
        f"SELECT {head}{float(p)}e0 AS prob, quantile_cont({col}, {float(p)}e0) AS value FROM {src}"
        + (f" GROUP BY {by}" if by else "") for p in probs)
    return rows


register("quantile_table", lambda s, d: quantiles(od(s, d), "avg", PROBS, method="hash"),
         quantile_sql("od_hourly", "avg"), ["od_hourly"], ["value"])
register("quantile_counts", lambda s, d: quantiles(
    flows.pair_counts(fx.trips(s, d)), "count", PROBS),
    quantile_sql("pair_counts", "count"), ["pair_counts"], ["value"])
register("quantile_duration_by_station", lambda s, d: quantiles(
    fx.trips(s, d), "trip_duration", PROBS, by=["start_station_id"]),
    quantile_sql("trips", "trip_duration", by="start_station_id"), ["trips"], ["value"])
register("top_percentile_filter", lambda s, d: top_percentile(od(s, d), "avg", 0.99, method="hash"),
         "SELECT * FROM od_hourly WHERE avg >= (SELECT quantile_cont(avg, 0.99e0) FROM od_hourly)",
         ["od_hourly"], ["avg"])
for when, hours in (("morning", (6, 9)), ("evening", (16, 19))):
    PAIRS = flow_sql(["start", "end"], *hours, hour="hour, ")
    register(f"top_percentile_{when}", lambda s, d, when=when: top_percentile(
        QUERIES[f"{when}_od"](s, d), "avg", 0.99, method="hash"),
        f"SELECT * FROM ({PAIRS}) WHERE avg >= (SELECT quantile_cont(avg, 0.99e0) FROM ({PAIRS}))",
        ["pairs_hourly", "stations"], ["avg"])
register("order_desc", lambda s, d: stats.ranked(
    od(s, d), ["avg"], ["start_commarea", "end_commarea", "hour"]),
    "SELECT * FROM od_hourly ORDER BY avg DESC, 2, 3, 1", ["od_hourly"], ["avg"])
register("order_sql", lambda s, d: flows.daily_trips(fx.trips(s, d)).orderBy("date"),
         "SELECT CAST(start_time AS DATE) AS date, count(*) AS trips FROM trips GROUP BY 1 ORDER BY 1",
         ["trips"])
register("reorder_factor", lambda s, d: stats.ranked(
    fx.trips(s, d).groupBy("user_type").agg(F.count("*").alias("n")), ["n"], ["user_type"], True),
    "SELECT user_type, count(*) AS n FROM trips GROUP BY 1 ORDER BY n, 1", ["trips"])
register("top_n", lambda s, d: stats.top_n(
    od(s, d), 20, "avg", within=["hour", "start_commarea", "end_commarea"])
    .select("start_commarea").distinct(),
    "SELECT DISTINCT start_commarea FROM od_hourly", ["od_hourly"])
register("top_n_intended", lambda s, d: stats.top_n(od(s, d), 20, "avg"),
         """SELECT * FROM od_hourly QUALIFY rank() OVER (ORDER BY avg DESC) <= 20""",
         ["od_hourly"], ["avg"])


def tagged(s, d):
    h, st = saved(hourly(s, d), "pairs-hourly"), saved(fx.stations(s, d), "stations")

    def part(role, lo, hi):
        return flows.area_flow(h, st, [role], (lo, hi)).withColumnRenamed(f"{role}_commarea", "community")
    return conform.union_tagged({"am_start": part("start", 6, 9), "am_end": part("end", 6, 9),
                                 "pm_start": part("start", 16, 19), "pm_end": part("end", 16, 19)})


def tagged_sql():
    parts = []
    for tag, role, lo, hi in (("am_start", "start", 6, 9), ("am_end", "end", 6, 9),
                              ("pm_start", "start", 16, 19), ("pm_end", "end", 16, 19)):
        parts.append(f"SELECT {role}_commarea AS community, total, num_days, avg, '{tag}' AS type "
                     f"FROM ({flow_sql([role], lo, hi)})")
    return " UNION ALL ".join(parts)


register("union_tagged", tagged, tagged_sql(), ["pairs_hourly", "stations"], ["avg"])
register("distinct_union_members", lambda s, d: fx.trips(s, d).select(F.col("start_station_id").alias("id"))
         .union(fx.trips(s, d).select("end_station_id")).distinct(),
         "SELECT start_station_id AS id FROM trips UNION SELECT end_station_id FROM trips", ["trips"])
register("minmax", lambda s, d: stats.minmax(od(s, d), "avg"),
         "SELECT min(avg) AS min_value, max(avg) AS max_value FROM od_hourly", ["od_hourly"],
         ["min_value", "max_value"])
register("category_count", lambda s, d: stats.category_count(
    fx.trips(s, d).withColumn("rush_hour", F.hour("start_time").isin(6, 7, 8, 9, 16, 17, 18, 19)), "rush_hour"),
    """SELECT hour(start_time) IN (6, 7, 8, 9, 16, 17, 18, 19) AS rush_hour, count(*) AS n
FROM trips GROUP BY 1""", ["trips"])
