"""Trips against weather, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloframe.functions import buckets, units
from veloframe.operators import conform, crossed, flows, regression, stats, weather
from veloframe.operators.quantiles import quantiles

from . import fixtures as fx
from .base import register
from .fixtures import HOLIDAYS
from .fleet import generation
from .flows import PROBS, od, quantile_sql


def days(s, d):
    return weather.daily_weather(fx.trips(s, d), fx.weather(s, d), HOLIDAYS)


def flagged(s, d):
    return conform.weekday_not_holiday(days(s, d), holidays=HOLIDAYS)


register("daily_weather", days, "SELECT * FROM days", ["days"])
RESPONSE = """SELECT {bucket} AS {name}, count(*) AS count, {extra}avg(trips) AS avg_trips,
  stddev_samp(trips) / sqrt(count(*)) AS se_trips
FROM days_flagged WHERE weekday_not_holiday GROUP BY 1"""


def response(key, value, bucket, bucket_sql, name, keep_value=True, drop_missing=False):
    def run(s, d):
        out = weather.weather_response(flagged(s, d), bucket(F.col(value)), name, value if keep_value else None)
        return conform.drop_incomplete(out) if drop_missing else out
    sql = RESPONSE.format(bucket=bucket_sql, name=name,
                          extra=f"avg({value}) AS avg_value, " if keep_value else "")
    floats = (["avg_value"] if keep_value else []) + ["avg_trips", "se_trips"]
    if drop_missing:
        sql = f"SELECT * FROM ({sql}) WHERE {name} IS NOT NULL AND se_trips IS NOT NULL"
    register(key, run, sql, ["days_flagged"], floats)


response("weather_by_temp", "max_temp", lambda v: buckets.floor_bucket(v, 5),
         "floor(max_temp / 5e0) * 5e0", "temperature_bucket")
response("weather_by_wind", "average_wind_speed", lambda v: buckets.floor_bucket(v, 1.5),
         "floor(average_wind_speed / 1.5e0) * 1.5e0", "wind_spd_bucket")
response("weather_by_snow", "snow_depth_mm",
         lambda v: buckets.round_half_away(units.inches(v)),
         "round(snow_depth_mm * 0.039e0, 0)", "round_snow_dep", keep_value=False)
for key, value, edges, name, sql in (
        ("weather_by_precip", "precip", buckets.PRECIP_EDGES, "precip_buckets",
         fx._cases("precip", fx.PRECIP, fx.PRECIP_LABELS)),
        ("weather_by_humidity", "relative_humidity", buckets.HUMIDITY_EDGES, "humid_buckets",
         fx._cases("relative_humidity", fx.HUMIDITY, fx.HUMIDITY_LABELS))):
    response(key, value, lambda v, edges=edges: buckets.cut(v, edges), sql, name,
             drop_missing=key == "weather_by_precip")
register("quantile_weather", lambda s, d: quantiles(
    fx.weather(s, d).select(units.inches(F.col("snow_depth_mm")).cast("double").alias("snow_in"),
                            F.col("precip").cast("double"), F.col("relative_humidity").cast("double").alias("humidity"))
    .unpivot([], ["snow_in", "precip", "humidity"], "type", "v"), "v", PROBS, by=["type"]),
    " UNION ALL ".join(f"SELECT prob, value, '{tag}' AS type FROM ({quantile_sql('weather', col)})"
                       for tag, col in (("snow_in", "(snow_depth_mm * 0.039e0)"), ("precip", "precip"),
                                        ("humidity", "relative_humidity"))), ["weather"], ["value"])


def station_days(s, d):
    banded = weather.with_temp_bands(days(s, d))
    return weather.station_day_weather(generation(s, d), banded)


register("gen_weather_join", station_days,
         """SELECT g.date, g.weekday, start_station_id, total_trips, w.* EXCLUDE (date, trips),
  max_temp < 0 AS freeze, max_temp >= 0 AND max_temp < 10 AS cold_0_to_10,
  max_temp >= 10 AND max_temp < 20 AS cool_10_to_20, max_temp >= 20 AND max_temp < 30 AS warm_20_to_30
FROM generation g LEFT JOIN days w ON g.date = w.date""", ["generation", "days"])
register("trip_generation_lm", lambda s, d: weather.fit_generation(
    weather.with_lag_generation(station_days(s, d)), 2024))

def fitted(s, d, features=weather.GENERATION_FEATURES):
    """(terms, figures) of the fit with its inference, for the year of the test tables."""
    rows = weather.with_lag_generation(station_days(s, d)).where(F.col("year") == 2024)
    return regression.linear_fit(rows, "log_total_trips", features)


register("trip_generation_terms", lambda s, d: fitted(s, d)[0])
register("trip_generation_fit", lambda s, d: fitted(s, d)[1])
TREND = """WITH w AS (SELECT log10(total_trips) AS y, year(date) AS yr,
  lag(log10(total_trips)) OVER (PARTITION BY date, weekday ORDER BY start_station_id) AS x FROM generation),
m AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx,
  (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) AS s2, regr_r2(y, x) AS r2
  FROM w WHERE yr = 2024 AND x IS NOT NULL AND y IS NOT NULL)
"""
register("trip_generation_trend", lambda s, d: fitted(s, d, ("lag_log_total_trips",))[0].drop("p_value"),
         TREND + """SELECT 'lag_log_total_trips' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error, b / sqrt(s2 / sxx) AS t_value FROM m
UNION ALL SELECT '(Intercept)', a, sqrt(s2 * (1 / n + mx * mx / sxx)), a / sqrt(s2 * (1 / n + mx * mx / sxx)) FROM m""",
         ["generation"], ["estimate", "std_error", "t_value"])
register("trip_generation_trend_fit", lambda s, d: fitted(s, d, ("lag_log_total_trips",))[1].select("n", "df", "sigma", "r_squared", "f_value", "aic"),
         TREND + """SELECT n, n - 2 AS df, sqrt(s2) AS sigma, r2 AS r_squared, b * b * sxx / s2 AS f_value,
  n * (ln(2 * pi() * s2 * (n - 2) / n) + 1) + 6 AS aic FROM m""", ["generation"], ["sigma", "r_squared", "f_value", "aic"])

TERMS = ("1", "lag_log_total_trips", "freeze", "cold_0_to_10", "cool_10_to_20", "warm_20_to_30", "precip", "snow_depth_mm",
         "log_total_trips")


def quoted(term: str) -> str:
    return term if term == "1" else f'"{term}"'


MOMENT_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, sum(CAST({quoted(a)} AS DOUBLE) * CAST({quoted(b)} AS DOUBLE)) AS value FROM used"
    for i, a in enumerate(TERMS) for b in TERMS[i:])
register("trip_generation_moments", lambda s, d: weather.generation_moments(
    weather.with_lag_generation(station_days(s, d)), 2024),
    f"""WITH banded AS (SELECT g.date, start_station_id, log10(total_trips) AS log_total_trips, g.weekday, w.* EXCLUDE (date, trips),
  max_temp < 0 AS freeze, max_temp >= 0 AND max_temp < 10 AS cold_0_to_10,
  max_temp >= 10 AND max_temp < 20 AS cool_10_to_20, max_temp >= 20 AND max_temp < 30 AS warm_20_to_30
FROM generation g LEFT JOIN days w ON g.date = w.date),
lagged AS (SELECT *, lag(log_total_trips) OVER (PARTITION BY date, weekday ORDER BY start_station_id) AS lag_log_total_trips FROM banded),
used AS (SELECT {', '.join(map(quoted, TERMS[1:]))} FROM lagged WHERE year(date) = 2024 AND {' AND '.join(f'{quoted(t)} IS NOT NULL' for t in TERMS[1:])})
{MOMENT_SQL}""", ["generation", "days"], ["value"])


def banded(s, d):
    rows = weather.with_temp_bands(weather.with_perceived_temp(flagged(s, d), "a"),
                                   "perceived_max_temp", with_hot=True)
    return rows.where("weekday_not_holiday").withColumn("log_trips", F.ln("trips"))


def variance(s, d):
    return stats.variance_share(banded(s, d), "log_trips", FACTORS)


FACTORS = ["visibility", "average_wind_speed", "snow_depth_mm", "precip", "relative_humidity",
           "freeze", "cold_0_to_10", "cool_10_to_20", "warm_20_to_30", "hot_30_plus"]
from .cleaning import CHILL, COLD, HUMID  # noqa: E402

PARTS = " UNION ALL ".join(f"SELECT '{f}' AS factor, CAST(banded.{f} AS VARCHAR) AS level, y FROM banded" for f in FACTORS)
BANDED = f"""felt AS (SELECT *, ln(trips) AS y, CASE WHEN {COLD} THEN {CHILL}
    WHEN max_temp > 20 AND dewp >= 283 THEN {HUMID} ELSE max_temp END AS t
  FROM days_flagged WHERE weekday_not_holiday),
banded AS (SELECT *, t < 0 AS freeze, t >= 0 AND t < 10 AS cold_0_to_10, t >= 10 AND t < 20 AS cool_10_to_20,
  t >= 20 AND t < 30 AS warm_20_to_30, t >= 30 AS hot_30_plus FROM felt)"""
register("variance_share", variance, f"""WITH {BANDED},
long AS ({PARTS}),
g AS (SELECT factor, level, count(*) AS n, avg(y) AS m FROM long GROUP BY ALL),
b AS (SELECT factor, count(*) AS levels, sum(n * (m - (SELECT avg(y) FROM banded)) * (m - (SELECT avg(y) FROM banded)))
  / sum(n) AS between_var FROM g GROUP BY factor)
SELECT factor, levels, between_var, between_var / (SELECT var_pop(y) FROM banded) AS r_squared,
  between_var / (SELECT sum(between_var) FROM b) * 100 AS prop_var FROM b""",
         ["days_flagged"], ["between_var", "r_squared", "prop_var"])
MARKS = " UNION ALL ".join(f"SELECT date, {i} AS i, '{f}' AS factor, CAST({quoted(f)} AS VARCHAR) AS level, y FROM full_rows" for i, f in enumerate(FACTORS))
register("weather_level_pairs", lambda s, d: crossed.level_pairs(banded(s, d), "log_trips", FACTORS),
         f"""WITH {BANDED}, full_rows AS (SELECT * FROM banded WHERE y IS NOT NULL AND {' AND '.join(f'{quoted(f)} IS NOT NULL' for f in FACTORS)}),
marks AS ({MARKS})
SELECT a.factor AS factor_a, a.level AS level_a, b.factor AS factor_b, b.level AS level_b, count(*) AS n, sum(a.y) AS sum_y
FROM marks a JOIN marks b ON a.date = b.date AND a.i <= b.i GROUP BY ALL""", ["days_flagged"], ["sum_y"])
for part, name in enumerate(("weather_components", "weather_component_tests", "weather_effects")):
    register(name, lambda s, d, part=part: crossed.crossed_fit(banded(s, d), "log_trips", FACTORS)[part])
register("quantile_breaks", lambda s, d: stats.quantile_breaks(od(s, d), "avg", 6, method="hash"),
         quantile_sql("od_hourly", "avg", [i / 6 for i in range(7)]), ["od_hourly"], ["prob", "value"])
register("break_labels", lambda s, d: stats.with_break_labels(
    od(s, d), "avg", [1, 2, 3, 4, 5, 6]).select("hour", "start_commarea", "end_commarea", "brks"),
    """WITH e AS (SELECT min(avg) AS lo, max(avg) AS hi FROM od_hourly),
b AS (SELECT list_sort([lo, 1e0, 2e0, 3e0, 4e0, 5e0, 6e0, hi]) AS b, [1e0, 2e0, 3e0, 4e0, 5e0, 6e0, hi] AS l FROM e)
SELECT hour, start_commarea, end_commarea, round(CASE WHEN avg <= b[2] THEN l[1] WHEN avg <= b[3] THEN l[2]
  WHEN avg <= b[4] THEN l[3] WHEN avg <= b[5] THEN l[4] WHEN avg <= b[6] THEN l[5] WHEN avg <= b[7] THEN l[6]
  WHEN avg <= b[8] THEN l[7] END, 2) AS brks FROM od_hourly, b""", ["od_hourly"], ["brks"])

# --- density -------------------------------------------------------------------------
NRD = """stat AS (SELECT min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1,
  1.06e0 * least(stddev_samp(longitude), (quantile_cont(longitude, 0.75e0) - quantile_cont(longitude, 0.25e0)) / 1.34e0)
    * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS hx,
  1.06e0 * least(stddev_samp(latitude), (quantile_cont(latitude, 0.75e0) - quantile_cont(latitude, 0.25e0)) / 1.34e0)
    * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS hy, sum(weight) AS total FROM docks),
cells AS (SELECT CAST(i AS INTEGER) AS gi, CAST(j AS INTEGER) AS gj, x0 + i * (x1 - x0) / 24e0 AS x,
  y0 + j * (y1 - y0) / 24e0 AS y FROM stat, range(25) a(i), range(25) b(j)),
sums AS (SELECT gi, gj, x, y, sum(weight * exp(-0.5e0 * ((x - longitude) / hx) * ((x - longitude) / hx))
  * exp(-0.5e0 * ((y - latitude) / hy) * ((y - latitude) / hy)) / (2e0 * pi())) AS ksum
  FROM cells, docks, stat GROUP BY gi, gj, x, y)"""
register("grid", lambda s, d: stats.grid(fx.docks(s, d), "longitude", "latitude", 25),
         f"WITH {NRD} SELECT gi, gj, x, y FROM cells", ["docks"], ["x", "y"])
register("grid_cross_join", lambda s, d: stats.kernel_sums(
    fx.docks(s, d), "longitude", "latitude", "weight", 25),
    f"WITH {NRD} SELECT gi, gj, ksum FROM sums", ["docks"], ["ksum"])
register("weighted_kde", lambda s, d: stats.weighted_kde(
    fx.docks(s, d), "longitude", "latitude", "weight", 25),
    f"WITH {NRD} SELECT gi, gj, x, y, ksum / (total * hx * hy) AS z FROM sums, stat",
    ["docks"], ["x", "y", "z"])
