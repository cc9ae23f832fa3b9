"""Projections, filters and row cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloframe.functions import buckets, cleaning, timefns, units
from veloframe.functions.holidays import RUSH_HOURS
from veloframe.operators import conform, flows, riders, sequence, speed, stats, weather

from . import fixtures as fx
from .base import register
from .fixtures import HOLIDAY_SQL, HOLIDAY_TS_SQL, HOLIDAYS, RUSH

HOURS = "(6, 7, 8, 9, 16, 17, 18, 19)"


def raw_docks(spark, d):
    """Two station snapshots that agree once coordinates are rounded."""
    t = fx.table(spark, d, "customer")
    k = F.col("c_custkey")

    def snapshot(shift):
        return t.select(k.alias("station_id"), F.col("c_name").alias("station_name"),
                        (F.lit(41.7) + F.lit(0.0000012) * k + F.lit(shift)).alias("latitude"),
                        (F.lit(-87.8) - F.lit(0.0000014) * k - F.lit(shift)).alias("longitude"))
    return snapshot(0.0).unionAll(snapshot(0.00000001))


RAW_DOCKS = """SELECT c_custkey AS station_id, c_name AS station_name,
    41.7e0 + 0.0000012e0 * c_custkey + shift AS latitude,
    -87.8e0 - 0.0000014e0 * c_custkey - shift AS longitude
  FROM customer, (VALUES (0e0), (0.00000001e0)) v(shift)"""

register("stations_dedup", lambda s, d: conform.build_stations(raw_docks(s, d)),
         f"""SELECT DISTINCT station_id AS external_id, station_name AS name,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM ({RAW_DOCKS})""")

ID_SQL = f"""SELECT row_number() OVER (ORDER BY external_id, latitude, longitude, name) AS id, *
FROM (SELECT DISTINCT station_id AS external_id, station_name AS name,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM ({RAW_DOCKS}))"""
register("surrogate_id",
         lambda s, d: conform.with_station_ids(conform.build_stations(raw_docks(s, d))), ID_SQL)
register("row_ids", lambda s, d: sequence.with_dense_index(
    fx.trips(s, d).select("start_time", F.col("id").alias("trip_id")), ["start_time", "trip_id"],
    F.to_date("start_time"), F.hour("start_time") * 60 + F.minute("start_time"), name="row_id"),
    """SELECT row_number() OVER (ORDER BY start_time, id) AS row_id, start_time, id AS trip_id
FROM trips""", ["trips"])

register("make_point", lambda s, d: fx.docks(s, d)
         .withColumn("point", cleaning.make_point(F.col("longitude"), F.col("latitude")))
         .select("id", F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat")),
         "SELECT id, longitude AS lon, latitude AS lat FROM docks", ["docks"])
register("clean_birth_year", lambda s, d: fx.trips_staging(s, d).select(
    "id", "birth_year_raw",
    cleaning.clean_birth_year(F.col("birth_year_raw")).alias("birth_year")),
    """SELECT id, birth_year_raw,
  CAST(NULLIF(NULLIF(birth_year_raw, ''), 'NULL') AS INTEGER) AS birth_year
FROM trips_staging""", ["trips_staging"])
register("subscriber_filter", lambda s, d: conform.known_subscribers(fx.trips(s, d))
         .select("id", "user_type", "gender", "birth_year"),
         """SELECT id, user_type, gender, birth_year FROM trips
WHERE user_type = 'Subscriber' AND gender IS NOT NULL AND birth_year BETWEEN 1940 AND 2005""",
         ["trips"])
register("rush_hours", lambda s, d: fx.trips(s, d).where(timefns.in_hours(F.col("start_time")))
         .select("id", "start_time"),
         f"SELECT id, start_time FROM trips WHERE hour(start_time) IN {HOURS}", ["trips"])
register("weekday_filter", lambda s, d: fx.trips(s, d)
         .withColumn("dow", timefns.pg_dow(F.col("start_time"))).where(F.col("dow").between(1, 5))
         .select("id", "dow"),
         """SELECT id, dayofweek(start_time) AS dow FROM trips
WHERE dayofweek(start_time) BETWEEN 1 AND 5""", ["trips"])
register("hour_between", lambda s, d: fx.trips(s, d)
         .where(timefns.hour_between(F.col("start_time"), 16, 19)).select("id", "start_time"),
         "SELECT id, start_time FROM trips WHERE hour(start_time) BETWEEN 16 AND 19", ["trips"])
register("not_holiday_ts", lambda s, d: conform.exclude_holidays(
    fx.trips(s, d), "start_time", HOLIDAYS).select("id", "start_time"),
    f"SELECT id, start_time FROM trips WHERE start_time NOT IN ({HOLIDAY_TS_SQL})", ["trips"])
register("not_holiday_ts_intended", lambda s, d: conform.exclude_holidays(
    fx.trips(s, d), "start_time", HOLIDAYS, by_date=True).select("id", "start_time"),
    f"SELECT id, start_time FROM trips WHERE CAST(start_time AS DATE) NOT IN ({HOLIDAY_SQL})",
    ["trips"])
register("holiday_flag", lambda s, d: flows.daily_trips(fx.trips(s, d)).withColumn(
    "holiday", conform.is_holiday(F.col("date"), HOLIDAYS)),
    f"""SELECT CAST(start_time AS DATE) AS date, count(*) AS trips,
  CAST(start_time AS DATE) IN ({HOLIDAY_SQL}) AS holiday FROM trips GROUP BY ALL""", ["trips"])
register("not_round_trip", lambda s, d: conform.not_round_trip(fx.trips(s, d))
         .select("id", "start_station_id", "end_station_id"),
         """SELECT id, start_station_id, end_station_id FROM trips
WHERE start_station_id != end_station_id""", ["trips"])
register("not_dependent", lambda s, d: conform.not_dependent(fx.trips(s, d)).select("id", "user_type"),
         "SELECT id, user_type FROM trips WHERE user_type != 'Dependent'", ["trips"])
register("membership", lambda s, d: fx.trips(s, d).where(F.col("gender").isin("Female", "Male"))
         .select("id", "gender"),
         "SELECT id, gender FROM trips WHERE gender IN ('Female', 'Male')", ["trips"])


def speeds(spark, d, by_date: bool = False):
    """Rush-hour trips with expected time, gap and speed."""
    t = fx.trips(spark, d)
    return speed.expected_vs_actual(
        speed.rush_hour_trips(t, HOLIDAYS, by_date),
        speed.pair_distance(t, fx.legs(spark, d), HOLIDAYS, by_date))


SPEED_COLS = ["total_m", "gm_trip_dur", "diff", "dist_miles", "trip_mph", "gm_mph"]
register("trim_outliers", lambda s, d: conform.trim(speeds(s, d), "trip_mph", 2.788, 15.3),
         "SELECT * FROM speed WHERE trip_mph BETWEEN 2.788e0 AND 15.3e0", ["speed"], SPEED_COLS)
register("drop_incomplete", lambda s, d: conform.drop_incomplete(fx.trips(s, d)),
         "SELECT * FROM trips WHERE gender IS NOT NULL AND birth_year IS NOT NULL", ["trips"])
register("min_support", lambda s, d: stats.min_support(flows.pair_counts(fx.trips(s, d)), 15),
         "SELECT * FROM pair_counts WHERE count >= 15", ["pair_counts"])
register("age", lambda s, d: riders.with_age(fx.trips(s, d)).select("id", "birth_year", "age"),
         "SELECT id, birth_year, year(start_time) - birth_year AS age FROM trips", ["trips"])
register("unit_convert", lambda s, d: fx.legs(s, d).select(
    "start_station_id", "end_station_id", "m", units.miles(F.col("m")).alias("miles"),
    units.kilometres(F.col("m")).alias("km"), units.inches(F.col("m")).alias("m_as_mm_in_inches"),
    units.kmh(F.col("minutes")).alias("kmh"), units.minutes(F.col("m")).alias("as_minutes"),
    units.mph(units.miles(F.col("m")), F.col("minutes") * 60).alias("mph")),
    """SELECT start_station_id, end_station_id, m, m / 1609.344e0 AS miles, m / 1000e0 AS km,
  m * 0.039e0 AS m_as_mm_in_inches, minutes * 3.6e0 AS kmh, m / 60e0 AS as_minutes,
  (m / 1609.344e0) / (minutes * 60 / 3600e0) AS mph FROM legs""", ["legs"],
    ["miles", "km", "m_as_mm_in_inches", "kmh", "as_minutes", "mph"])
register("duration_gap", lambda s, d: speeds(s, d).select(
    "start_station_id", "end_station_id", "gender", "actual_trip_duration", "gm_trip_dur", "diff"),
    """SELECT start_station_id, end_station_id, gender, actual_trip_duration, gm_trip_dur, diff
FROM speed""", ["speed"], ["gm_trip_dur", "diff"])
register("weekday_label", lambda s, d: fx.trips(s, d).select(
    "id", timefns.weekday_label(F.col("start_time")).alias("dow")),
    """SELECT id, CASE WHEN dayofweek(start_time) IN (1, 2, 3, 4, 5) THEN 'Weekdays'
  WHEN dayofweek(start_time) IN (0, 6) THEN 'Weekends' END AS dow FROM trips""", ["trips"])
BLOCK = """CASE WHEN hour >= 6 AND hour < 10 THEN 'peak_morn' WHEN hour >= 10 AND hour < 14 THEN 'midday'
  WHEN hour >= 14 AND hour < 18 THEN 'peak_aft' WHEN hour >= 18 AND hour < 23 THEN 'even'
  WHEN hour >= 23 {op} hour < 6 THEN 'overnight' END"""
for suffix, wraps, op in (("", False, "AND"), ("_intended", True, "OR")):
    register(f"day_block{suffix}", lambda s, d, wraps=wraps: fx.trips(s, d).select(
        "id", timefns.day_block(F.hour("start_time"), wraps).alias("day_block")),
        f"""SELECT id, {BLOCK.format(op=op)} AS day_block
FROM (SELECT id, hour(start_time) AS hour FROM trips)""", ["trips"])
register("temp_flags", lambda s, d: weather.with_temp_bands(
    fx.weather(s, d).select("date", "max_temp"), with_hot=True),
    """SELECT date, max_temp, max_temp < 0 AS freeze, max_temp >= 0 AND max_temp < 10 AS cold_0_to_10,
  max_temp >= 10 AND max_temp < 20 AS cool_10_to_20, max_temp >= 20 AND max_temp < 30 AS warm_20_to_30,
  max_temp >= 30 AS hot_30_plus FROM weather""", ["weather"])
register("weekday_not_holiday", lambda s, d: conform.weekday_not_holiday(
    fx.weather(s, d).select("date"), holidays=HOLIDAYS),
    f"""SELECT date, dayofweek(date) BETWEEN 1 AND 5 AS weekday,
  dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN ({HOLIDAY_SQL}) AS weekday_not_holiday
FROM weather""", ["weather"])
register("rush_flag", lambda s, d: fx.trips(s, d).select(
    "id", F.hour("start_time").isin(*RUSH_HOURS).alias("rush_hour")),
    f"SELECT id, hour(start_time) IN {HOURS} AS rush_hour FROM trips", ["trips"])
register("axis_time", lambda s, d: fx.trips(s, d).select(
    "id", timefns.axis_time(F.hour("start_time")).alias("timestamp_x")),
    "SELECT id, TIMESTAMP '1970-01-01' + to_hours(hour(start_time)) AS timestamp_x FROM trips",
    ["trips"])

CHILL = """13.12e0 + 0.6215e0 * max_temp - 11.37e0 * pow(average_wind_speed * 3.6e0, 0.16e0)
    + 0.3965e0 * max_temp * pow(average_wind_speed * 3.6e0, 0.16e0)"""
HUMID = """max_temp + 5e0 / 9e0 * (6.11e0 * exp(5417.753e0 * (1e0 / 273.16e0 - 1e0 / dewp)) - 10e0)"""
COLD = "max_temp <= 0 AND average_wind_speed * 3.6e0 >= 5"
register("perceived_temp_a", lambda s, d: weather.with_perceived_temp(fx.weather(s, d), "a")
         .select("date", "max_temp", "dewp", "perceived_max_temp"),
         f"""SELECT date, max_temp, dewp, CASE WHEN {COLD} THEN {CHILL}
  WHEN max_temp > 20 AND dewp >= 283 THEN {HUMID} ELSE max_temp END AS perceived_max_temp
FROM weather""", ["weather"], ["perceived_max_temp"])
register("perceived_temp_b", lambda s, d: weather.with_perceived_temp(fx.weather(s, d), "b")
         .select("date", "max_temp", "dewp", "perceived_max_temp"),
         f"""SELECT date, max_temp, dewp, CASE WHEN max_temp >= 20 AND dewp >= 10 THEN {HUMID}
  ELSE max_temp END AS perceived_max_temp FROM weather""", ["weather"], ["perceived_max_temp"])
register("perceived_temp_b_intended",
         lambda s, d: weather.with_perceived_temp(fx.weather(s, d), "b_intended")
         .select("date", "max_temp", "dewp", "perceived_max_temp"),
         f"""SELECT date, max_temp, dewp, CASE WHEN max_temp >= 20 AND dewp >= 283 THEN {HUMID}
  WHEN {COLD} THEN {CHILL}
  WHEN max_temp < 0 AND average_wind_speed * 3.6e0 BETWEEN 0 AND 5
    THEN max_temp + (-1.59e0 + 0.1345e0 * max_temp) / 5e0 * average_wind_speed
  ELSE max_temp END AS perceived_max_temp FROM weather""", ["weather"], ["perceived_max_temp"])
register("route_key", lambda s, d: fx.trips(s, d).select(
    "id", cleaning.route_key(F.col("start_station_id"), F.col("end_station_id")).alias("grp")),
    "SELECT id, concat_ws('.', start_station_id, end_station_id) AS grp FROM trips", ["trips"])
register("coord_text", lambda s, d: fx.docks(s, d).select("id", cleaning.coord_text(
    F.round("latitude", 5), F.round("longitude", 5)).alias("coord")),
    "SELECT id, round(latitude, 5) || ', ' || round(longitude, 5) AS coord FROM docks", ["docks"])
register("blank_gender_filter", lambda s, d: fx.trips(s, d).where(F.col("gender") != "")
         .select("id", "gender"),
         "SELECT id, gender FROM trips WHERE gender != ''", ["trips"])
register("fill_if_null", lambda s, d: conform.fill_if_null(
    fx.docks(s, d).select("id", F.when(F.col("id") % 3 == 0, F.col("latitude")).alias("latitude")),
    fx.docks(s, d).select("id", (F.col("latitude") + 1).alias("latitude")), "id", ["latitude"]),
    """SELECT a.id, coalesce(CASE WHEN a.id % 3 = 0 THEN a.latitude END, b.latitude + 1) AS latitude
FROM docks a LEFT JOIN docks b USING (id)""", ["docks"])
register("project_rename", lambda s, d: fx.trips(s, d).select(
    "bike_id", F.col("id").alias("trip"), F.col("trip_duration").alias("seconds"))
    .withColumnRenamed("bike_id", "bike"),
    "SELECT bike_id AS bike, id AS trip, trip_duration AS seconds FROM trips", ["trips"])
register("distinct_rows", lambda s, d: fx.trips(s, d)
         .select("start_station_id", "end_station_id", "user_type").distinct(),
         "SELECT DISTINCT start_station_id, end_station_id, user_type FROM trips", ["trips"])
register("bbox", lambda s, d: conform.in_bbox(
    fx.trip_points(s, d), "longitude", "latitude", -87.827344, 41.716999, -87.532917, 42.0819),
    """SELECT * FROM trip_points WHERE longitude BETWEEN -87.827344e0 AND -87.532917e0
  AND latitude BETWEEN 41.716999e0 AND 42.0819e0""", ["trip_points"])
register("outlier_listing", lambda s, d: stats.ranked(
    speeds(s, d).where(F.col("diff") / 60 > 100)
    .select("start_station_id", "end_station_id", "gender", "age", "diff"), ["diff"],
    ["start_station_id", "end_station_id", "age"]),
    """SELECT start_station_id, end_station_id, gender, age, diff FROM speed WHERE diff / 60 > 100
ORDER BY diff DESC, 1, 2, 4""", ["speed"], ["diff"])

# --- scalar function families ------------------------------------------------
register("fn_datetime", lambda s, d: fx.trips(s, d).select(
    "id", F.to_date("start_time").alias("date"), F.hour("start_time").alias("hour"),
    F.month("start_time").alias("month"), F.year("start_time").alias("year"),
    timefns.pg_dow(F.col("start_time")).alias("dow"),
    timefns.round_to_hour(F.col("start_time")).alias("round_hour"),
    timefns.round_to_day(F.col("start_time")).alias("round_day"),
    timefns.month_start(F.col("stop_time")).alias("month_start"),
    F.date_sub(F.to_date("start_time"), 27).alias("window_start")),
    """SELECT id, CAST(start_time AS DATE) AS date, hour(start_time) AS hour,
  month(start_time) AS month, year(start_time) AS year, dayofweek(start_time) AS dow,
  CAST(date_trunc('hour', start_time + INTERVAL 30 MINUTE) AS TIMESTAMP) AS round_hour,
  CAST(date_trunc('day', start_time + INTERVAL 12 HOUR) AS TIMESTAMP) AS round_day,
  CAST(date_trunc('month', stop_time) AS DATE) AS month_start,
  CAST(start_time AS DATE) - 27 AS window_start FROM trips""", ["trips"])
register("fn_math", lambda s, d: fx.weather(s, d).select(
    "date", F.round("max_temp", 0).alias("rounded"), F.floor(F.col("max_temp") / 5).alias("floored"),
    F.abs("max_temp").alias("absolute"), F.signum("max_temp").alias("sign"),
    F.sqrt(F.abs("max_temp")).alias("root"), F.exp(F.col("max_temp") / 10).alias("exponential"),
    F.pow(F.col("dewp"), F.lit(0.16)).alias("power"), F.ln("dewp").alias("natural_log"),
    F.log10("dewp").alias("common_log"), F.expr("cast(cast(max_temp / 3 as int) as double)").alias("truncated")),
    """SELECT date, round(max_temp, 0) AS rounded, CAST(floor(max_temp / 5) AS BIGINT) AS floored,
  abs(max_temp) AS absolute, CAST(sign(max_temp) AS DOUBLE) AS sign, sqrt(abs(max_temp)) AS root,
  exp(max_temp / 10) AS exponential, pow(dewp, 0.16e0) AS power, ln(dewp) AS natural_log,
  log10(dewp) AS common_log, trunc(max_temp / 3) AS truncated FROM weather""", ["weather"],
    ["root", "exponential", "power", "natural_log", "common_log"])
register("fn_null_conditional_cast", lambda s, d: fx.trips_staging(s, d).select(
    "id", F.nullif("gender", F.lit("")).alias("gender"), F.col("gender").isNull().alias("no_gender"),
    F.when(F.col("user_type") == "Subscriber", 1).otherwise(0).alias("subscriber"),
    (F.col("start_station_id") != F.col("end_station_id")).cast("int").alias("moved"),
    F.col("trip_duration").cast("double").alias("seconds"), F.col("bike_id").cast("string").alias("bike")),
    """SELECT id, NULLIF(gender, '') AS gender, gender IS NULL AS no_gender,
  CASE WHEN user_type = 'Subscriber' THEN 1 ELSE 0 END AS subscriber,
  CAST(start_station_id != end_station_id AS INTEGER) AS moved,
  CAST(trip_duration AS DOUBLE) AS seconds, CAST(bike_id AS VARCHAR) AS bike
FROM trips_staging""", ["trips_staging"])
register("fn_string_bit", lambda s, d: fx.table(s, d, "events").select(
    "event_id", F.length("props").alias("chars"), F.substring("event_type", 2, 1).alias("second"),
    F.ascii(F.substring("event_type", 2, 1)).alias("code"),
    F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("pasted"),
    F.col("user_id").bitwiseAND(F.lit(31)).alias("low"),
    F.col("user_id").bitwiseOR(F.lit(64)).alias("merged"),
    F.shiftleft("user_id", 5).alias("lefted"), F.shiftright("user_id", 1).alias("righted")),
    """SELECT event_id, length(props) AS chars, substring(event_type, 2, 1) AS second,
  ascii(substring(event_type, 2, 1)) AS code, concat_ws('.', event_type, user_id) AS pasted,
  user_id & 31 AS low, user_id | 64 AS merged, user_id << 5 AS lefted, user_id >> 1 AS righted
FROM events""")
register("cut_buckets", lambda s, d: speed.with_buckets(speeds(s, d)).select(
    "age", "dist_miles", "gm_trip_dur", "age_bucket", "dist_bucket", "expected_bucket",
    buckets.cut_ordinal(F.col("age"), buckets.AGE_EDGES).alias("age_level")),
    f"""SELECT age, dist_miles, gm_trip_dur, age_bucket, dist_bucket, expected_bucket,
  {fx._cases('age', fx.AGES, range(1, 11)).replace("'", "")} AS age_level
FROM speed_bucketed""", ["speed_bucketed"], ["dist_miles", "gm_trip_dur"])
