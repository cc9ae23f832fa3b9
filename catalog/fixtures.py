"""Views over the given tables in the shape of the bike-share inputs.

Each view exists twice: as a DataFrame and as a DuckDB common table expression
(``CTE``) with the same expressions.  See FIXTURES.md for the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOLIDAYS = ("2024-01-01", "2024-01-15")
HOLIDAY_SQL = "DATE '2024-01-01', DATE '2024-01-15'"
HOLIDAY_TS_SQL = "TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-15 00:00:00'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trips_staging(spark, d) -> DataFrame:
    """Trips before cleaning: birth year is still text."""
    ev = table(spark, d, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    ts = F.col("ts").cast("timestamp_ntz")
    dur = F.floor(F.col("value") * 60).cast("int") + 60
    return ev.select(
        F.col("event_id").alias("id"), user.alias("bike_id"), dur.alias("trip_duration"),
        ts.alias("start_time"), F.timestamp_add("SECOND", dur, ts).alias("stop_time"),
        (F.col("event_id") % 25).cast("int").alias("start_station_id"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 25).alias("end_station_id"),
        F.when(kind == "error", "Dependent").when(kind == "view", "Customer")
        .otherwise("Subscriber").alias("user_type"),
        F.when(kind.isin("error", "view") | (user % 4 == 3), F.lit(None).cast("string"))
        .when(user % 29 == 5, "").when(user % 4 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(user % 11 == 0, "").when(user % 13 == 0, "NULL")
        .otherwise((1935 + user % 75).cast("string")).alias("birth_year_raw"))


def trips(spark, d) -> DataFrame:
    from veloframe.functions.cleaning import clean_birth_year
    return (trips_staging(spark, d)
            .withColumn("birth_year", clean_birth_year(F.col("birth_year_raw")))
            .drop("birth_year_raw"))


def stations(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        key.alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("commarea"),
        (F.lit(41.70) + F.lit(0.013) * key).alias("latitude"),
        (F.lit(-87.83) + F.lit(0.011) * ((key * 7) % 25)).alias("longitude"))


def legs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    s, e, n = F.col("l_suppkey") % 25, F.col("l_partkey") % 25, F.col("l_linenumber")
    lat, lon = F.lit(41.70) + F.lit(0.013) * s, F.lit(-87.83) + F.lit(0.011) * e
    size = F.lit(0.5) + F.lit(0.25) * ((s * 7 + e) % 20)   # longer steps on some pairs
    return li.select(
        s.cast("int").alias("start_station_id"), e.cast("int").alias("end_station_id"),
        (lat + F.lit(0.001) * n).alias("start_lat"), (lat + F.lit(0.001) * (n + 1)).alias("end_lat"),
        (lon + F.lit(0.002) * n).alias("start_lon"), (lon + F.lit(0.002) * (n + 1)).alias("end_lon"),
        (F.col("l_quantity") * size).alias("m"), (F.col("l_quantity") * size / 200).alias("minutes"))


def weather(spark, d) -> DataFrame:
    p, size, key = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    return p.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (key - 1).cast("int")).alias("date"),
        (size - 18).cast("double").alias("average_temp"),
        (key % 10 + 1).cast("double").alias("visibility"),
        ((size % 12) * F.lit(0.9)).alias("average_wind_speed"),
        (size - 15).cast("double").alias("max_temp"), (size - 20).cast("double").alias("min_temp"),
        ((key % 7) * F.lit(0.1)).alias("precip"), (size + 255).cast("double").alias("dewp"),
        ((key % 9) * 25).cast("double").alias("snow_depth_mm"),
        (key % 5 == 0).alias("fog"), (key % 3 == 0).alias("rain_drizzle"),
        (size < 15).alias("snow_ice"), (key % 50 == 0).alias("hail"),
        (key % 20 == 0).alias("thunder"), (key % 1000 == 999).alias("tornado_funnel"),
        (30 + (key * 7) % 70).cast("double").alias("relative_humidity"))


def docks(spark, d) -> DataFrame:
    """Points for the area joins, one per customer."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), (F.lit(41.70) + F.lit(0.00037) * ((k * 37) % 1000)).alias("latitude"),
        (F.lit(-87.83) + F.lit(0.00029) * ((k * 91) % 997)).alias("longitude"),
        (k % 50 + 1).cast("double").alias("weight"))


def trip_points(spark, d) -> DataFrame:
    """Points for the spatial joins, one per event."""
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k.alias("id"), (F.lit(41.68) + F.lit(0.00041) * ((k * 613) % 1009)).alias("latitude"),
        (F.lit(-87.85) + F.lit(0.00033) * ((k * 417) % 1013)).alias("longitude"))


def _corners(df: DataFrame, corners) -> DataFrame:
    """Explode fixed corner offsets (ring, pos, dx, dy) of each polygon."""
    arr = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(p).alias("pos"),
                             F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy"))
                    for r, p, x, y in corners])
    return (df.select("*", F.explode(arr).alias("_c")).select(
        "gid", "name", "_c.ring", "_c.pos",
        (F.col("x0") + F.col("_c.dx") * F.col("sx")).alias("x"),
        (F.col("y0") + F.col("_c.dy") * F.col("sy")).alias("y")))


DIAMOND = [(0, 0, -1, 0), (0, 1, 0, 1), (0, 2, 1, 0), (0, 3, 0, -1), (0, 4, -1, 0)]
SQUARE_WITH_HOLE = [(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (0, 3, 0, 1), (0, 4, 0, 0),
                    (1, 0, .4, .4), (1, 1, .6, .4), (1, 2, .6, .6), (1, 3, .4, .6), (1, 4, .4, .4)]


def tracts(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    half = F.lit(0.012) + F.lit(0.004) * (k % 5)
    return _corners(table(spark, d, "supplier").select(
        (k + 1).alias("gid"), F.concat(F.lit("TRACT_"), k.cast("string")).alias("name"),
        (F.lit(-87.83) + F.lit(0.0028) * ((k * 53) % 101)).alias("x0"),
        (F.lit(41.70) + F.lit(0.0037) * ((k * 29) % 97)).alias("y0"),
        half.alias("sx"), half.alias("sy")), DIAMOND)


def communities(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return _corners(table(spark, d, "nation").select(
        (k + 1).alias("gid"), F.col("n_name").alias("name"),
        (F.lit(-87.84) + F.lit(0.062) * (k % 5)).alias("x0"),
        (F.lit(41.69) + F.lit(0.078) * F.floor(k / 5)).alias("y0"),
        F.lit(0.06).alias("sx"), F.lit(0.076).alias("sy")), SQUARE_WITH_HOLE)


def route_steps(spark, d) -> DataFrame:
    """Saved route steps, one per line item, each an encoded two-point line."""
    def ch(e):
        return F.char(e)
    li = table(spark, d, "lineitem")
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    line = F.concat(ch(95 + p % 32), ch(63 + s % 32), ch(95 + o % 32), ch(63 + n % 32),
                    ch(63 + o % 32), ch(63 + p % 31))
    return li.select(
        (s % 25).cast("int").alias("id_start"), (p % 25).cast("int").alias("id_end"),
        o.alias("step_no"), n.alias("line_no"), line.alias("polyline"),
        (F.col("l_quantity") * 4).alias("distance_m"),
        (F.col("l_extendedprice") / 100).alias("duration_s"))


def daily_orders(spark, d) -> DataFrame:
    return (table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count("*").alias("trips")))


def daily_shipments(spark, d) -> DataFrame:
    """Distinct (date, bike) pairs with seven years of dates."""
    return table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("bike_id")).distinct()


def _values(corners) -> str:
    return ", ".join(f"({r}, {p}, {float(x)}e0, {float(y)}e0)" for r, p, x, y in corners)


CTE = {
    "trips_staging": """trips_staging AS (
  SELECT event_id AS id, user_id AS bike_id,
    CAST(floor(value * 60) AS INTEGER) + 60 AS trip_duration, ts AS start_time,
    ts + to_seconds(CAST(floor(value * 60) AS INTEGER) + 60) AS stop_time,
    CAST(event_id % 25 AS INTEGER) AS start_station_id,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 25 AS end_station_id,
    CASE event_type WHEN 'error' THEN 'Dependent' WHEN 'view' THEN 'Customer'
      ELSE 'Subscriber' END AS user_type,
    CASE WHEN event_type IN ('error', 'view') OR user_id % 4 = 3 THEN NULL
      WHEN user_id % 29 = 5 THEN '' WHEN user_id % 4 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN user_id % 11 = 0 THEN '' WHEN user_id % 13 = 0 THEN 'NULL'
      ELSE CAST(1935 + user_id % 75 AS VARCHAR) END AS birth_year_raw
  FROM events)""",
    "trips": """trips AS (
  SELECT id, bike_id, trip_duration, start_time, stop_time, start_station_id, end_station_id,
    user_type, gender, CAST(NULLIF(NULLIF(birth_year_raw, ''), 'NULL') AS INTEGER) AS birth_year
  FROM trips_staging)""",
    "stations": """stations AS (
  SELECT n_nationkey AS id, n_name AS name, r_name AS commarea,
    41.70e0 + 0.013e0 * n_nationkey AS latitude,
    -87.83e0 + 0.011e0 * ((n_nationkey * 7) % 25) AS longitude
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "legs": """legs AS (
  SELECT CAST(l_suppkey % 25 AS INTEGER) AS start_station_id,
    CAST(l_partkey % 25 AS INTEGER) AS end_station_id,
    41.70e0 + 0.013e0 * (l_suppkey % 25) + 0.001e0 * l_linenumber AS start_lat,
    41.70e0 + 0.013e0 * (l_suppkey % 25) + 0.001e0 * (l_linenumber + 1) AS end_lat,
    -87.83e0 + 0.011e0 * (l_partkey % 25) + 0.002e0 * l_linenumber AS start_lon,
    -87.83e0 + 0.011e0 * (l_partkey % 25) + 0.002e0 * (l_linenumber + 1) AS end_lon,
    l_quantity * (0.5e0 + 0.25e0 * ((l_suppkey % 25 * 7 + l_partkey % 25) % 20)) AS m,
    l_quantity * (0.5e0 + 0.25e0 * ((l_suppkey % 25 * 7 + l_partkey % 25) % 20)) / 200 AS minutes
  FROM lineitem)""",
    "weather": """weather AS (
  SELECT DATE '2024-01-01' + CAST(p_partkey - 1 AS INTEGER) AS date,
    CAST(p_size - 18 AS DOUBLE) AS average_temp, CAST(p_partkey % 10 + 1 AS DOUBLE) AS visibility,
    (p_size % 12) * 0.9e0 AS average_wind_speed, CAST(p_size - 15 AS DOUBLE) AS max_temp,
    CAST(p_size - 20 AS DOUBLE) AS min_temp, (p_partkey % 7) * 0.1e0 AS precip,
    CAST(p_size + 255 AS DOUBLE) AS dewp, CAST((p_partkey % 9) * 25 AS DOUBLE) AS snow_depth_mm,
    p_partkey % 5 = 0 AS fog, p_partkey % 3 = 0 AS rain_drizzle, p_size < 15 AS snow_ice,
    p_partkey % 50 = 0 AS hail, p_partkey % 20 = 0 AS thunder,
    p_partkey % 1000 = 999 AS tornado_funnel,
    CAST(30 + (p_partkey * 7) % 70 AS DOUBLE) AS relative_humidity
  FROM part)""",
    "docks": """docks AS (
  SELECT c_custkey AS id, 41.70e0 + 0.00037e0 * ((c_custkey * 37) % 1000) AS latitude,
    -87.83e0 + 0.00029e0 * ((c_custkey * 91) % 997) AS longitude,
    CAST(c_custkey % 50 + 1 AS DOUBLE) AS weight
  FROM customer)""",
    "trip_points": """trip_points AS (
  SELECT event_id AS id, 41.68e0 + 0.00041e0 * ((event_id * 613) % 1009) AS latitude,
    -87.85e0 + 0.00033e0 * ((event_id * 417) % 1013) AS longitude
  FROM events)""",
    "tracts": f"""tracts AS (
  SELECT s_suppkey + 1 AS gid, 'TRACT_' || s_suppkey AS name, ring, pos,
    -87.83e0 + 0.0028e0 * ((s_suppkey * 53) % 101) + dx * (0.012e0 + 0.004e0 * (s_suppkey % 5)) AS x,
    41.70e0 + 0.0037e0 * ((s_suppkey * 29) % 97) + dy * (0.012e0 + 0.004e0 * (s_suppkey % 5)) AS y
  FROM supplier, (VALUES {_values(DIAMOND)}) corner(ring, pos, dx, dy))""",
    "communities": f"""communities AS (
  SELECT n_nationkey + 1 AS gid, n_name AS name, ring, pos,
    -87.84e0 + 0.062e0 * (n_nationkey % 5) + dx * 0.06e0 AS x,
    41.69e0 + 0.078e0 * (n_nationkey // 5) + dy * 0.076e0 AS y
  FROM nation, (VALUES {_values(SQUARE_WITH_HOLE)}) corner(ring, pos, dx, dy))""",
    "tract_edges": """tract_edges AS (
  SELECT * FROM (SELECT gid, name, x AS x1, y AS y1,
    lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM tracts
    WINDOW w AS (PARTITION BY gid, ring ORDER BY pos)) WHERE x2 IS NOT NULL)""",
    "community_edges": """community_edges AS (
  SELECT * FROM (SELECT gid, name, x AS x1, y AS y1,
    lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM communities
    WINDOW w AS (PARTITION BY gid, ring ORDER BY pos)) WHERE x2 IS NOT NULL)""",
    "daily_orders": """daily_orders AS (
  SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS trips FROM orders GROUP BY 1)""",
    "daily_shipments": """daily_shipments AS (
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, l_suppkey AS bike_id FROM lineitem)""",
    # vertices of route_steps: the closed form of its six-character lines
    "route_vertices": """route_codes AS (
  SELECT CAST(l_suppkey % 25 AS INTEGER) AS id_start, CAST(l_partkey % 25 AS INTEGER) AS id_end,
    l_orderkey AS step_no, l_linenumber AS line_no, l_quantity * 4 AS m,
    l_extendedprice / 100 / 60.0e0 AS minutes,
    (l_partkey % 32) + 32 * (l_suppkey % 32) AS za, (l_orderkey % 32) + 32 * (l_linenumber % 32) AS zb,
    l_orderkey % 32 AS zc, l_partkey % 31 AS zd
  FROM lineitem),
route_deltas AS (
  SELECT *, CASE WHEN za % 2 = 1 THEN -(za // 2) - 1 ELSE za // 2 END AS a,
    CASE WHEN zb % 2 = 1 THEN -(zb // 2) - 1 ELSE zb // 2 END AS b,
    CASE WHEN zc % 2 = 1 THEN -(zc // 2) - 1 ELSE zc // 2 END AS c,
    CASE WHEN zd % 2 = 1 THEN -(zd // 2) - 1 ELSE zd // 2 END AS e
  FROM route_codes),
route_vertices AS (
  SELECT id_start, id_end, step_no, line_no, vertex_no,
    CAST(a + CASE WHEN vertex_no = 1 THEN c ELSE 0 END AS DOUBLE) * 1e-5 AS lat,
    CAST(b + CASE WHEN vertex_no = 1 THEN e ELSE 0 END AS DOUBLE) * 1e-5 AS lon, m, minutes
  FROM route_deltas, (VALUES (0), (1)) v(vertex_no))""",
}

NEEDS = {
    "trips": ["trips_staging"], "tract_edges": ["tracts"], "community_edges": ["communities"],
}

# Summaries several queries start from.
RUSH = ("hour(start_time) IN (6, 7, 8, 9, 16, 17, 18, 19) AND dayofweek(start_time) BETWEEN 1 AND 5")
CTE["pairs_hourly"] = f"""pairs_hourly AS (
  SELECT CAST(start_time AS DATE) AS date, hour(start_time) AS hour, start_station_id,
    end_station_id, count(*) AS trips, CAST(start_time AS DATE) IN ({HOLIDAY_SQL}) AS holiday
  FROM trips GROUP BY ALL)"""
CTE["pairs_weekday"] = """pairs_weekday AS (
  SELECT * FROM pairs_hourly WHERE dayofweek(date) BETWEEN 1 AND 5)"""
CTE["pairs_daily"] = f"""pairs_daily AS (
  SELECT CAST(start_time AS DATE) AS date, dayofweek(start_time) AS weekday, start_station_id,
    end_station_id, count(*) AS trips, CAST(start_time AS DATE) IN ({HOLIDAY_SQL}) AS holiday
  FROM trips GROUP BY ALL)"""
CTE["od_hourly"] = """od_hourly AS (
  SELECT w.hour, ss.commarea AS start_commarea, es.commarea AS end_commarea,
    CAST(sum(trips) AS BIGINT) AS total, count(DISTINCT date) AS num_days,
    CAST(sum(trips) AS DOUBLE) / count(DISTINCT date) AS avg
  FROM pairs_weekday w JOIN stations ss ON w.start_station_id = ss.id
    JOIN stations es ON w.end_station_id = es.id GROUP BY ALL)"""
CTE["chain"] = """chain AS (
  SELECT * FROM (SELECT id, bike_id, start_time, stop_time, end_station_id,
    lead(start_station_id) OVER w AS next_start_station_id, lead(start_time) OVER w AS next_start_time
    FROM trips WINDOW w AS (PARTITION BY bike_id ORDER BY start_time, id))
  WHERE next_start_station_id IS NOT NULL)"""
for period, expr in (("all", None), ("month", "CAST(date_trunc('month', stop_time) AS DATE)"),
                     ("hour", "hour(stop_time)")):
    head = f"{expr} AS {period}, " if expr else ""
    CTE[f"transport_{period}"] = f"""transport_{period} AS (
  SELECT {head}end_station_id, count(*) AS total_drop_offs,
    CAST(sum(CAST(end_station_id != next_start_station_id AS INTEGER)) AS BIGINT)
      AS transported_to_other_station
  FROM chain GROUP BY ALL)"""
    NEEDS[f"transport_{period}"] = ["chain"]
CTE["days"] = f"""days AS (
  SELECT a.date, a.trips, w.* EXCLUDE (date), dayofweek(a.date) AS dow, month(a.date) AS month,
    year(a.date) AS year, a.date IN ({HOLIDAY_SQL}) AS holiday
  FROM (SELECT CAST(start_time AS DATE) AS date, count(*) AS trips FROM trips GROUP BY 1) a
    JOIN weather w ON a.date = w.date)"""
CTE["days_flagged"] = """days_flagged AS (
  SELECT *, dow BETWEEN 1 AND 5 AS weekday, dow BETWEEN 1 AND 5 AND NOT holiday AS weekday_not_holiday
  FROM days)"""
CTE["generation"] = """generation AS (
  SELECT date, weekday, start_station_id, CAST(sum(trips) AS BIGINT) AS total_trips
  FROM pairs_daily GROUP BY ALL)"""
CTE["pair_dist"] = f"""pair_dist AS (
  WITH riders AS (
    SELECT start_station_id, end_station_id, user_type, gender, count(*) AS count FROM trips
    WHERE user_type != 'Dependent' AND start_station_id != end_station_id AND {RUSH}
      AND start_time NOT IN ({HOLIDAY_TS_SQL}) GROUP BY ALL)
  SELECT start_station_id, end_station_id, user_type, gender, count,
    sum(DISTINCT m) AS total_m, sum(DISTINCT minutes) AS total_min
  FROM riders JOIN legs USING (start_station_id, end_station_id) GROUP BY ALL)"""
CTE["rush"] = f"""rush AS (
  SELECT trip_duration AS actual_trip_duration, user_type, year(start_time) - birth_year AS age,
    start_station_id, end_station_id, gender FROM trips
  WHERE {RUSH} AND gender IS NOT NULL AND user_type = 'Subscriber'
    AND birth_year BETWEEN 1940 AND 2005 AND start_station_id != end_station_id
    AND start_time NOT IN ({HOLIDAY_TS_SQL}))"""
CTE["speed"] = """speed_joined AS (
  SELECT r.*, p.total_m, p.total_min * 60.0e0 AS gm_trip_dur, p.total_m / 1609.344e0 AS dist_miles
  FROM rush r LEFT JOIN pair_dist p ON r.start_station_id = p.start_station_id
    AND r.end_station_id = p.end_station_id AND r.user_type = p.user_type
    AND r.gender IS NOT DISTINCT FROM p.gender
  WHERE r.gender IN ('Male', 'Female')),
speed AS (
  SELECT actual_trip_duration, user_type, age, start_station_id, end_station_id, gender, total_m,
    gm_trip_dur, actual_trip_duration - gm_trip_dur AS diff, dist_miles,
    dist_miles / (actual_trip_duration / 3600.0e0) AS trip_mph,
    dist_miles / (gm_trip_dur / 3600.0e0) AS gm_mph
  FROM speed_joined)"""


def swapped(sql: str, *pairs: tuple[str, str]) -> str:
    """``sql`` with texts exchanged; a text that is not there is an error."""
    for old, new in pairs:
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


def _cases(col: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {col} >= {float(lo)}e0 AND {col} < {float(hi)}e0 THEN '{lab}'"
                    for lo, hi, lab in zip(edges, edges[1:], labels))
    return f"CASE {arms} END"


# Edges and labels written out: the library's own are what these queries test.
AGES = (0, 18, 22, 25, 30, 35, 40, 45, 50, 60, 100)
AGE_LABELS = ("[0,18)", "[18,22)", "[22,25)", "[25,30)", "[30,35)", "[35,40)", "[40,45)", "[45,50)", "[50,60)", "[60,100)")
MILES = (0, 1, 1.5, 2.5, 15)
MILE_LABELS = ("< 1 miles", "1 to 1.5 miles", "1.5 to 2.5 miles", "≥2.5 miles")
SECONDS = (0, 300, 600, 900, 1200, 5000)
SECOND_LABELS = ("Exp <5 minutes", "Exp 5-10 minutes", "Exp 10-15 minutes", "Exp 15-20 minutes", "Exp ≥ 25 minutes")
PRECIP = (0, 0.001, 0.01, 0.1, 0.2, 0.4, 1, 10)
PRECIP_LABELS = ("[0,0.001)", "[0.001,0.01)", "[0.01,0.1)", "[0.1,0.2)", "[0.2,0.4)", "[0.4,1)", "[1,10)")
HUMIDITY = (36.584, 50, 54.2, 66.7, 75, 83.3, 100)
HUMIDITY_LABELS = ("[36.6,50)", "[50,54.2)", "[54.2,66.7)", "[66.7,75)", "[75,83.3)", "[83.3,100)")


def speed_buckets_sql() -> str:
    return f"""speed_bucketed AS (
  SELECT *, {_cases('age', AGES, AGE_LABELS)} AS age_bucket,
    {_cases('dist_miles', MILES, MILE_LABELS)} AS dist_bucket,
    {_cases('gm_trip_dur', SECONDS, SECOND_LABELS)} AS expected_bucket
  FROM speed)"""


CTE["speed_bucketed"] = speed_buckets_sql()
CTE["speed_complete"] = """speed_complete AS (
  SELECT * FROM speed_bucketed WHERE age IS NOT NULL AND total_m IS NOT NULL
    AND gm_trip_dur IS NOT NULL AND trip_mph IS NOT NULL AND gm_mph IS NOT NULL
    AND age_bucket IS NOT NULL AND dist_bucket IS NOT NULL AND expected_bucket IS NOT NULL)"""
STATS_SQL = """avg(diff) AS mean_diff, median(diff) AS med_diff, stddev_samp(diff) AS sd_diff,
    avg(trip_mph) AS mean_mph, median(trip_mph) AS med_mph, stddev_samp(trip_mph) AS sd_mph,
    count(*) AS count, avg(gm_trip_dur) AS mean_exp, avg(age) AS mean_age, median(age) AS med_age"""
CTE["bucket_stats"] = f"""bucket_stats AS (
  SELECT dist_bucket, age_bucket, gender, {STATS_SQL} FROM speed_complete
  WHERE trip_mph > 3 AND trip_mph < 15 GROUP BY ALL)"""
CTE["bucket_long"] = """bucket_long AS (
  SELECT dist_bucket, age_bucket, gender, count, mean_exp, mean_age, med_age, speed_stats, speed,
    diff_stats, diff
  FROM bucket_stats,
    LATERAL (VALUES ('mean_mph', mean_mph), ('med_mph', med_mph), ('sd_mph', sd_mph)) a(speed_stats, speed),
    LATERAL (VALUES ('mean_diff', mean_diff), ('med_diff', med_diff), ('sd_diff', sd_diff)) b(diff_stats, diff))"""
for unit, shift in (("hour", "INTERVAL 30 MINUTE"), ("day", "INTERVAL 12 HOUR")):
    CTE[f"anon_{unit}"] = f"""anon_{unit} AS (
  SELECT date_trunc('{unit}', start_time + {shift}) AS round_{unit}, start_station_id, gender,
    year(start_time) - birth_year AS age, count(*) AS count
  FROM trips WHERE user_type = 'Subscriber' AND gender IS NOT NULL
    AND birth_year BETWEEN 1940 AND 2005 GROUP BY ALL)"""
    NEEDS[f"anon_{unit}"] = ["trips"]
CTE["rider_base"] = """rider_base AS (
  SELECT user_type, gender, year(start_time) - birth_year AS age, count(*) AS count
  FROM trips WHERE user_type != 'Dependent' GROUP BY user_type, gender, start_time, birth_year)"""
CTE["pair_counts"] = """pair_counts AS (
  SELECT start_station_id, end_station_id, count(*) AS count,
    count(DISTINCT CAST(start_time AS DATE)) AS num_days
  FROM trips WHERE start_station_id != end_station_id GROUP BY ALL)"""
NEEDS |= {
    "pairs_hourly": ["trips"], "pairs_daily": ["trips"], "pairs_weekday": ["pairs_hourly"],
    "od_hourly": ["pairs_weekday", "stations"], "chain": ["trips"], "days": ["trips", "weather"],
    "days_flagged": ["days"], "generation": ["pairs_daily"], "pair_dist": ["trips", "legs"],
    "rush": ["trips"], "speed": ["rush", "pair_dist"], "speed_bucketed": ["speed"],
    "speed_complete": ["speed_bucketed"], "bucket_stats": ["speed_complete"],
    "bucket_long": ["bucket_stats"], "rider_base": ["trips"], "pair_counts": ["trips"],
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` preceded by the named views and all they need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(CTE[n] for n in done) + "\n" + body) if done else body
