"""Rider shares, re-identification, speed."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloframe.functions import units
from veloframe.operators import conform, flows, riders, speed, stats
from veloframe.operators.quantiles import distributed_quantiles, quantiles, top_percentile

from . import fixtures as fx
from .base import register
from .cleaning import SPEED_COLS, speeds
from .fixtures import HOLIDAYS, STATS_SQL
from .flows import PROBS, quantile_sql

for unit, name in (("hour", "anon_hourly"), ("day", "anon_daily")):
    register(name, lambda s, d, unit=unit: riders.anon_counts(fx.trips(s, d), unit),
             f"SELECT * REPLACE (CAST(round_{unit} AS TIMESTAMP) AS round_{unit}) FROM anon_{unit}",
             [f"anon_{unit}"])


def identifiable(s, d, unit="hour"):
    return riders.identifiability(riders.anon_counts(fx.trips(s, d), unit))


IDENT = """SELECT gender, age, count(*) AS total,
  avg(CASE WHEN count = 1 THEN 1e0 ELSE 0e0 END) AS fraction
FROM anon_{unit} WHERE gender != '' GROUP BY ALL"""
register("identifiable_by_age", identifiable, IDENT.format(unit="hour"), ["anon_hour"], ["fraction"])
register("identifiable_by_age_daily", lambda s, d: identifiable(s, d, "day"),
         IDENT.format(unit="day"), ["anon_day"], ["fraction"])
register("identifiable_mean", lambda s, d: riders.identifiability_mean(identifiable(s, d)),
         f"SELECT avg(fraction) AS mean_fraction FROM ({IDENT.format(unit='hour')})", ["anon_hour"],
         ["mean_fraction"])
register("identifiable_mean_by_gender",
         lambda s, d: riders.identifiability_mean(identifiable(s, d), ["gender"]),
         f"SELECT gender, avg(fraction) AS mean_fraction FROM ({IDENT.format(unit='hour')}) GROUP BY 1",
         ["anon_hour"], ["mean_fraction"])


def base(s, d):
    return riders.rider_base(fx.trips(s, d))


register("subscriber_base", base, "SELECT * FROM rider_base", ["rider_base"])
register("usertype_share", lambda s, d: stats.share(base(s, d), ["user_type"], "count"),
         """SELECT user_type, CAST(sum(count) AS BIGINT) AS sum,
  sum(count) / CAST(sum(sum(count)) OVER () AS DOUBLE) * 100 AS prop
FROM rider_base GROUP BY user_type""", ["rider_base"], ["prop"])
register("gender_share", lambda s, d: stats.share(
    riders.known_age_and_gender(base(s, d)), ["user_type", "gender"], "count", ["user_type"]),
    """SELECT user_type, gender, CAST(sum(count) AS BIGINT) AS sum,
  sum(count) / CAST(sum(sum(count)) OVER (PARTITION BY user_type) AS DOUBLE) * 100 AS prop
FROM rider_base WHERE age IS NOT NULL AND coalesce(gender, '?') NOT IN ('', 'NA')
GROUP BY user_type, gender""", ["rider_base"], ["prop"])
register("share_of_total", lambda s, d: stats.share(
    base(s, d), ["user_type", "gender"], "count"),
    """SELECT user_type, gender, CAST(sum(count) AS BIGINT) AS sum,
  sum(count) / CAST(sum(sum(count)) OVER () AS DOUBLE) * 100 AS prop
FROM rider_base GROUP BY user_type, gender""", ["rider_base"], ["prop"])
register("age_stats", lambda s, d: riders.age_stats(base(s, d)),
         """SELECT user_type, gender, count(*) AS count, avg(age) AS mean_age, median(age) AS median_age
FROM rider_base WHERE age IS NOT NULL AND gender IN ('Female', 'Male') GROUP BY ALL""",
         ["rider_base"], ["mean_age", "median_age"])

# --- distances and speed ---------------------------------------------------------


def pair_dist(s, d, by_date=False):
    return speed.pair_distance(fx.trips(s, d), fx.legs(s, d), HOLIDAYS, by_date)


register("pair_distance", pair_dist, "SELECT * FROM pair_dist", ["pair_dist"], ["total_m", "total_min"])
BY_DATE = (f"start_time NOT IN ({fx.HOLIDAY_TS_SQL})", f"CAST(start_time AS DATE) NOT IN ({fx.HOLIDAY_SQL})")
INTENDED = fx.swapped(fx.CTE["pair_dist"], ("pair_dist AS", "pair_dist_intended AS"), BY_DATE)
fx.CTE["pair_dist_intended"] = INTENDED
fx.NEEDS["pair_dist_intended"] = ["trips", "legs"]
register("pair_distance_fine_steps", lambda s, d: speed.pair_distance(
    fx.trips(s, d), fx.legs(s, d).select("start_station_id", "end_station_id", F.expr(
        "inline(array(named_struct('m', cast(m as double), 'minutes', cast(minutes as double)), "
        "named_struct('m', m + 3e-7D, 'minutes', minutes + 2e6D)))")), HOLIDAYS).select(
            "start_station_id", "end_station_id", "user_type", "gender", "total_m", "total_min"),
    """SELECT start_station_id, end_station_id, user_type, gender, total_m, total_min
FROM (SELECT start_station_id, end_station_id, sum(DISTINCT m) AS total_m FROM
    (SELECT start_station_id, end_station_id, m FROM legs UNION ALL SELECT start_station_id, end_station_id, m + 3e-7 FROM legs)
    GROUP BY ALL)
JOIN (SELECT start_station_id, end_station_id, sum(DISTINCT minutes) AS total_min FROM
    (SELECT start_station_id, end_station_id, minutes FROM legs UNION ALL SELECT start_station_id, end_station_id, minutes + 2e6 FROM legs)
    GROUP BY ALL) USING (start_station_id, end_station_id)
JOIN (SELECT DISTINCT start_station_id, end_station_id, user_type, gender FROM pair_dist) USING (start_station_id, end_station_id)""",
    ["pair_dist", "legs"], ["total_m", "total_min"])
register("pair_distance_intended", lambda s, d: pair_dist(s, d, True),
         "SELECT * FROM pair_dist_intended", ["pair_dist_intended"], ["total_m", "total_min"])
register("expected_vs_actual", speeds, "SELECT * FROM speed", ["speed"], SPEED_COLS)


INTENDED_RUSH = fx.swapped(fx.CTE["rush"], ("rush AS", "rush_intended AS"), BY_DATE)
fx.CTE["rush_intended"] = INTENDED_RUSH
fx.CTE["speed_intended"] = fx.swapped(fx.CTE["speed"], ("rush r", "rush_intended r"), ("pair_dist p", "pair_dist_intended p"),
                                      ("speed AS (", "speed_intended AS ("))
fx.NEEDS |= {"rush_intended": ["trips"], "speed_intended": ["rush_intended", "pair_dist_intended"]}
register("expected_vs_actual_intended", lambda s, d: speeds(s, d, by_date=True),
         "SELECT * FROM speed_intended", ["speed_intended"], SPEED_COLS)


def subscriber_pairs(s, d):
    rows = pair_dist(s, d).where((F.col("user_type") == "Subscriber")
                                 & F.col("gender").isin("Female", "Male"))
    return rows.withColumn("dist_miles", units.miles(F.col("total_m")))


SUB = """(SELECT *, total_m / 1609.344e0 AS dist_miles FROM pair_dist
  WHERE user_type = 'Subscriber' AND gender IN ('Female', 'Male'))"""
register("weighted_distance", lambda s, d: stats.weighted_mean(
    subscriber_pairs(s, d), "dist_miles", "count", ["user_type"]),
    f"""SELECT user_type, sum(dist_miles * count) / CAST(sum(count) AS DOUBLE) AS wtd_mean
FROM {SUB} GROUP BY 1""", ["pair_dist"], ["wtd_mean"])
STAT_COLS = ["mean_diff", "med_diff", "sd_diff", "mean_mph", "med_mph", "sd_mph", "mean_exp",
             "mean_age", "med_age"]
register("speed_by_age", lambda s, d: speed.speed_stats(
    conform.trim(speeds(s, d), "trip_mph", 2.788, 15.3), ["age", "gender"]),
    f"""SELECT age, gender, {STATS_SQL} FROM speed
WHERE trip_mph BETWEEN 2.788e0 AND 15.3e0 GROUP BY age, gender""", ["speed"], STAT_COLS)


def complete(s, d):
    return conform.drop_incomplete(speed.with_buckets(speeds(s, d)))


register("speed_by_distance_bucket", lambda s, d: speed.speed_by_distance_bucket(complete(s, d)),
         """SELECT dist_bucket, avg(diff) / 60 AS mean_diff, stddev_samp(diff) / 60 AS sd_diff,
  avg(trip_mph) AS mean_mph, stddev_samp(trip_mph) AS sd_mph FROM speed_complete GROUP BY 1""",
         ["speed_complete"], ["mean_diff", "sd_diff", "mean_mph", "sd_mph"])


def bucket_stats(s, d):
    rows = conform.trim(complete(s, d), "trip_mph", 3, 15, closed=False)
    return speed.speed_stats(rows, ["dist_bucket", "age_bucket", "gender"])


def bucket_long(s, d):
    return speed.unpivot_gap(speed.unpivot_speed(bucket_stats(s, d)))


register("speed_buckets", bucket_stats, "SELECT * FROM bucket_stats", ["bucket_stats"], STAT_COLS)
register("unpivot_speed", lambda s, d: speed.unpivot_speed(bucket_stats(s, d)).select(
    "dist_bucket", "age_bucket", "gender", "count", "speed_stats", "speed"),
    """SELECT dist_bucket, age_bucket, gender, count, speed_stats, speed FROM bucket_stats,
  LATERAL (VALUES ('mean_mph', mean_mph), ('med_mph', med_mph), ('sd_mph', sd_mph)) a(speed_stats, speed)""",
    ["bucket_stats"], ["speed"])
register("unpivot_gap", bucket_long, "SELECT * FROM bucket_long", ["bucket_long"],
         ["mean_exp", "mean_age", "med_age", "speed", "diff"])

# The literal roll-ups average mean, median and sd rows together; the intended
# ones keep the mean rows only.
SPEED_SETS = [["gender", "age_bucket"], ["gender"], []]
GAP_SETS = [["gender", "age_bucket"], ["gender", "dist_bucket"], ["gender"], []]
ROLL = """SELECT {cols}, CASE WHEN count({v}) = count(*) THEN avg({v}){scale} END AS {name},
  count(*) AS n FROM bucket_long {where} GROUP BY GROUPING SETS ({sets})"""


def sets_sql(sets):
    return ", ".join("(" + ", ".join(s) + ")" for s in sets)


for suffix, stat in (("", None), ("_intended", "mean")):
    register(f"speed_rollups{suffix}", lambda s, d, stat=stat: speed.rollup_mean(
        bucket_long(s, d) if stat is None else bucket_long(s, d).where(
            "speed_stats = 'mean_mph' AND diff_stats = 'mean_diff'"),
        "speed", SPEED_SETS, "mean_speed").select("gender", "age_bucket", "mean_speed", "n"),
        ROLL.format(cols="gender, age_bucket", v="speed", scale="", name="mean_speed",
                    where="" if stat is None else "WHERE speed_stats = 'mean_mph' AND diff_stats = 'mean_diff'",
                    sets=sets_sql(SPEED_SETS)), ["bucket_long"], ["mean_speed"])
    register(f"gap_rollups{suffix}", lambda s, d, stat=stat: speed.rollup_mean(
        bucket_long(s, d) if stat is None else bucket_long(s, d).where(
            "speed_stats = 'mean_mph' AND diff_stats = 'mean_diff'"),
        "diff", GAP_SETS, "mean_diff", 60.0).select("gender", "age_bucket", "dist_bucket", "mean_diff", "n"),
        ROLL.format(cols="gender, age_bucket, dist_bucket", v="diff", scale=" / 60", name="mean_diff",
                    where="" if stat is None else "WHERE speed_stats = 'mean_mph' AND diff_stats = 'mean_diff'",
                    sets=sets_sql(GAP_SETS)), ["bucket_long"], ["mean_diff"])
register("age_mean_gap", lambda s, d: speed.gap_by_age(speeds(s, d)),
         "SELECT age, gender, count(*) AS count, avg(diff) AS mean_diff FROM speed GROUP BY ALL",
         ["speed"], ["mean_diff"])
register("age_mean_speed", lambda s, d: speed.speed_by_age(speeds(s, d)),
         """SELECT age, gender, count(*) AS count, avg(trip_mph) AS mean_speed FROM speed
WHERE gender != '' GROUP BY ALL""", ["speed"], ["mean_speed"])
register("distance_profile", lambda s, d: speed.distance_profile(speeds(s, d)),
         """SELECT round_even(total_m, 1) AS nearest_dist_m, gender, count(*) AS count,
  avg(round_even(total_m, 1)) AS mean_dist, avg(diff) AS mean_diff, avg(trip_mph) AS mean_speed
FROM speed WHERE gender != '' GROUP BY 1, 2""", ["speed"],
         ["nearest_dist_m", "mean_dist", "mean_diff", "mean_speed"])
register("quantile_speed", lambda s, d: quantiles(speeds(s, d), "trip_mph", PROBS),
         quantile_sql("speed", "trip_mph"), ["speed"], ["value"])
register("quantile_speed_by_gender", lambda s, d: quantiles(speeds(s, d), "gm_mph", PROBS, by=["gender"]),
         quantile_sql("speed", "gm_mph", by="gender"), ["speed"], ["value"])

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
register("quantile_distance", lambda s, d: quantiles(
    speeds(s, d).select(F.expr("stack(2, 'dist_miles', cast(dist_miles as double), 'gm_trip_dur', "
                               "cast(gm_trip_dur as double)) as (type, v)")), "v", QUARTILES, by=["type"]),
    " UNION ALL ".join(f"SELECT prob, value, '{c}' AS type FROM ({quantile_sql('speed', c, QUARTILES)})"
                       for c in ("dist_miles", "gm_trip_dur")), ["speed"], ["value"])
# Prices with added outliers: heavy tails on both sides, cut into small parts.
PRICE = "l_extendedprice * CASE WHEN l_linenumber = 7 AND l_orderkey % 50 = 0 THEN 1e3 WHEN l_orderkey % 97 = 0 THEN -1e1 ELSE 1 END"
register("quantile_outliers", lambda s, d: distributed_quantiles(
    s.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.expr(f"cast({PRICE} as double)").alias("v")), "v",
    [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0], by=["l_returnflag"], part_rows=5000),
    " UNION ALL ".join(f"SELECT l_returnflag, {p!r}e0 AS prob, quantile_cont(CAST({PRICE} AS DOUBLE), {p!r}e0) AS value "
                       "FROM lineitem GROUP BY 1" for p in (0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0)), (), ["value"])
# Group counts are few (ages times genders), so the hash method is bounded.
register("quantile_support", lambda s, d: quantiles(
    speed.gap_by_age(speeds(s, d)), "count", PROBS, method="hash"),
    quantile_sql("(SELECT count(*) AS count FROM speed GROUP BY age, gender)", "count"), ["speed"], ["value"])
register("min_support_percentile", lambda s, d: top_percentile(
    flows.pair_counts(fx.trips(s, d)), "count", 0.9),
    "SELECT * FROM pair_counts WHERE count >= (SELECT quantile_cont(count, 0.9e0) FROM pair_counts)",
    ["pair_counts"])

# --- binned pictures ----------------------------------------------------------------
HEX = """WITH p AS (SELECT {by}{x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
e AS (SELECT min(x) AS x0, min(y) AS y0, (max(x) - min(x)) / 30e0 AS wx,
  (max(y) - min(y)) / 30e0 * sqrt(3e0) AS wy FROM p),
u AS (SELECT {by}x0, y0, wx, wy, coalesce((x - x0) / nullif(wx, 0), 0e0) AS u,
  coalesce((y - y0) / nullif(wy, 0), 0e0) AS w FROM p, e),
c AS (SELECT *, floor(u + 0.5e0) AS au, floor(w + 0.5e0) AS aw, floor(u) + 0.5e0 AS bu,
  floor(w) + 0.5e0 AS bw FROM u),
n AS (SELECT *, (u - au) * (u - au) + 3e0 * (w - aw) * (w - aw)
  <= (u - bu) * (u - bu) + 3e0 * (w - bw) * (w - bw) AS first FROM c),
g AS (SELECT {by}CASE WHEN first THEN au ELSE bu END AS hex_u, CASE WHEN first THEN aw ELSE bw END AS hex_w,
  count(*) AS count, any_value(x0) AS x0, any_value(y0) AS y0, any_value(wx) AS wx, any_value(wy) AS wy
FROM n GROUP BY ALL)
SELECT {by}hex_u, hex_w, count, x0 + hex_u * wx AS center_x, y0 + hex_w * wy AS center_y FROM g"""
HEX_COLS = ["center_x", "center_y"]
register("hexbin", lambda s, d: stats.hexbin(
    subscriber_pairs(s, d), "dist_miles", "count", log_x=True, log_y=True),
    HEX.format(by="", x="log10(dist_miles)", y="log10(count)", src=SUB), ["pair_dist"], HEX_COLS)


def trimmed(s, d):
    rows = conform.drop_incomplete(speeds(s, d)).withColumn("gap_min", F.col("diff") / 60)
    return conform.trim(rows, "trip_mph", 3, 15, closed=False)


TRIMMED = """(SELECT *, diff / 60 AS gap_min FROM speed WHERE age IS NOT NULL AND total_m IS NOT NULL
  AND gm_trip_dur IS NOT NULL AND trip_mph > 3 AND trip_mph < 15)"""
register("hexbin_gap", lambda s, d: stats.hexbin(trimmed(s, d), "age", "gap_min", by=["gender"]),
         HEX.format(by="gender, ", x="age", y="gap_min", src=TRIMMED), ["speed"], HEX_COLS)
register("hexbin_speed", lambda s, d: stats.hexbin(trimmed(s, d), "age", "trip_mph", by=["gender"]),
         HEX.format(by="gender, ", x="age", y="trip_mph", src=TRIMMED), ["speed"], HEX_COLS)
register("histogram", lambda s, d: stats.histogram(
    conform.trim(speeds(s, d), "trip_mph", 2.788, 15.306, closed=False), "trip_mph"),
    """WITH v AS (SELECT trip_mph AS v FROM speed WHERE trip_mph > 2.788e0 AND trip_mph < 15.306e0),
e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30e0 AS width FROM v)
SELECT CAST(coalesce(least(floor((v - lo) / nullif(width, 0)), 29), 0) AS INTEGER) AS bin,
  count(*) AS count, any_value(lo) + bin * any_value(width) AS bin_start FROM v, e GROUP BY bin""",
    ["speed"], ["bin_start"])
