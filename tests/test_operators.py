"""Operators on micro fixtures and against brute force."""

import math
import random
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloframe.operators import (conform, fleet, flows, quantiles, riders, routes, sequence, spatial, speed,
                                 stats, weather)


def trips(spark, data):
    """(id, bike, start text, from, to) rows; a trip takes ten minutes."""
    rows = [(i, b, t, s, e) for i, b, t, s, e in data]
    df = spark.createDataFrame(rows, "id long, bike_id long, t string, start_station_id int, end_station_id int")
    return df.select("id", "bike_id", F.col("t").cast("timestamp_ntz").alias("start_time"),
                     (F.col("t").cast("timestamp_ntz") + F.expr("interval 10 minutes")).alias("stop_time"),
                     "start_station_id", "end_station_id")


# --- next pick-up -----------------------------------------------------------
def test_chain_breaks_ties_by_id_and_drops_single_trips(spark, rows):
    t = trips(spark, [(2, 1, "2015-01-01 08:00:00", 5, 6), (1, 1, "2015-01-01 08:00:00", 3, 4),
                      (3, 1, "2015-01-01 09:00:00", 6, 7), (4, 9, "2015-01-01 09:00:00", 1, 2)])
    got = rows(fleet.bike_chain(t).select("id", "next_start_station_id"))
    assert got == [(1, 5), (2, 6)]


@pytest.mark.parametrize("seconds", [1, 3600, 10**9])
def test_chain_is_the_same_for_all_slices(spark, rows, seconds):
    rnd = random.Random(7)
    base = datetime(2015, 1, 1)
    data = [(i, 1 if rnd.random() < 0.5 else rnd.randrange(2, 9),
             str(base + timedelta(minutes=rnd.randrange(0, 3000))), rnd.randrange(5), rnd.randrange(5))
            for i in range(400)]
    data += [(400 + i, 1 + i % 3, None, i % 5, 2) for i in range(9)]
    want = []
    for bike in {d[1] for d in data}:
        own = sorted(((d[2], d[0], d[3]) for d in data if d[1] == bike), key=lambda r: (r[0] or "", r[1:]))
        want += [(a[1], bike, b[2], b[0]) for a, b in zip(own, own[1:])]
    got = fleet.bike_chain(trips(spark, data), seconds).select(
        "id", "bike_id", "next_start_station_id", F.col("next_start_time").cast("string"))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("seconds", [60, 3600, 10**9])
def test_a_trip_without_start_gets_its_next_one(spark, rows, seconds):
    t = trips(spark, [(1, 1, None, 1, 2), (2, 1, "2015-01-01 08:00:00", 3, 4), (3, 1, "2015-01-01 10:00:00", 5, 6)])
    assert rows(fleet.bike_chain(t, seconds).select("id", "next_start_station_id")) == [(1, 3), (2, 5)]


def test_moved_bikes(spark, rows):
    t = trips(spark, [(1, 1, "2015-01-31 23:55:00", 1, 2), (2, 1, "2015-02-01 08:00:00", 2, 3),
                      (3, 1, "2015-02-01 09:00:00", 4, 5), (4, 1, "2015-02-02 09:00:00", 5, 5)])
    chain = fleet.bike_chain(t)
    assert rows(fleet.transport_counts(chain)) == [(2, 1, 0), (3, 1, 1), (5, 1, 0)]
    month = fleet.transport_counts(chain, "month")
    assert rows(month)[0] == (date(2015, 2, 1), 2, 1, 0)      # by drop-off, not start
    total = fleet.transport_rate(fleet.transport_counts(chain)).first()
    assert total.perc == pytest.approx(1 / 3) and total.total == 3


# --- trailing windows ---------------------------------------------------------
def test_trailing_distinct_equals_brute_force(spark):
    rnd = random.Random(3)
    first = date(2014, 1, 1)
    seen = {(first + timedelta(days=rnd.choice([0, 1, 2, 30, 31, 75, 140])), rnd.randrange(6)) for _ in range(30)}
    df = spark.createDataFrame(sorted(seen), "date date, bike_id int")
    got = {r.date: r.bikes for r in fleet.trailing_distinct(df, "bike_id", "date", 28, "2014-01-02", "2014-06-30").collect()}
    want = {}
    for k in range(180):
        day = date(2014, 1, 2) + timedelta(days=k)
        n = len({b for d, b in seen if day - timedelta(days=27) <= d <= day})
        if n:
            want[day] = n
    assert got == want


@pytest.mark.parametrize("block", [4, 4096])
def test_rolling_sum_counts_rows_not_days(spark, block):
    days = [date(2015, 1, 1) + timedelta(days=3 * i) for i in range(40)]
    df = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, trips long")
    got = {r.date: r.total for r in sequence.rolling_sum(
        df, "date", "trips", 5, F.trunc("date", "month"), "total", block=block).collect()}
    for i, d in enumerate(days):
        assert got[d] == (None if i < 4 else sum(range(i - 3, i + 2)))


def test_rolling_sum_shorter_than_window(spark):
    df = spark.createDataFrame([(date(2015, 1, 1), 5)], "date date, trips long")
    assert sequence.rolling_sum(df, "date", "trips", 28, F.trunc("date", "month"), "s").first().s is None


@pytest.mark.parametrize("fine", [False, True])
def test_dense_index_has_no_gaps(spark, fine):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(100)], "v int")
    buckets = [F.floor(F.col("v") / 10)] + ([F.floor(F.col("v") / 3)] if fine else [])
    got = sequence.with_dense_index(df, ["v"], *buckets, name="n").collect()
    assert [r.v for r in sorted(got)] == sorted(r.v for r in got)
    assert sorted(r.n for r in got) == list(range(1, 101))


# --- quantiles ------------------------------------------------------------------
@pytest.mark.parametrize("part_rows", [10**6, 1, 50])
def test_distributed_quantiles_are_exact(spark, part_rows):
    rnd = random.Random(11)
    data = [(g if g else None, v) for g in range(4) for v in
            [round(rnd.expovariate(0.1) * (1000 if rnd.random() < 0.05 else 1), 3) for _ in range(1 + 90 * g)]]
    data += [(3, 5.0)] * 200 + [(9, None)]
    df = spark.createDataFrame(data, "g int, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]

    def type7(vals, p):
        vals = sorted(vals)
        h = (len(vals) - 1) * p
        lo = int(h)
        return vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (h - lo)

    got = {(r.g, r.prob): r.value for r in quantiles.distributed_quantiles(
        df, "v", probs, ["g"], part_rows=part_rows).collect()}
    groups = {g: [v for k, v in data if k == g and v is not None] for g, _ in data}
    assert got == {(g, p): pytest.approx(type7(vs, p)) for g, vs in groups.items() if vs for p in probs}
    whole = {r.prob: r.value for r in quantiles.distributed_quantiles(
        df, "v", probs, part_rows=part_rows).collect()}
    flat = [v for _, v in data if v is not None]
    assert whole == {p: pytest.approx(type7(flat, p)) for p in probs}


@pytest.mark.parametrize("part_rows", [10**6, 1])
def test_infinite_values_are_values(spark, part_rows):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, math.inf, math.inf)], "v double")
    got = quantiles.distributed_quantiles(df, "v", [0.5, 0.6, 0.75, 1.0], part_rows=part_rows).orderBy("prob")
    assert [r.value for r in got.collect()] == [3.0, math.inf, math.inf, math.inf]


def test_heavy_tails_leave_no_large_part(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("cast(id as double) / 20000 as v").union(spark.sql("select 1e6D as v"))
    sizes = []

    def keep(frame, purpose, inner=quantiles.saved):
        out = inner(frame, purpose)
        if purpose == "value-parts":
            sizes.append(out.agg(F.max("_rows")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "saved", keep)
    got = quantiles.distributed_quantiles(df, "v", [0.5, 0.99], part_rows=500).orderBy("prob").collect()
    assert [r.value for r in got] == pytest.approx([0.5, 0.99])
    assert sizes[0] == 20_001 and sizes[-1] <= 500 and len(sizes) <= 3


def test_quantile_methods_agree_on_small_input(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    for method in ("distributed", "hash", "sketch"):
        assert [r.value for r in quantiles.quantiles(df, "v", [0.25, 0.5], method=method)
                .orderBy("prob").collect()] == [25.0, 50.0]
    assert quantiles.top_percentile(df, "v", 0.99).count() == 2
    assert quantiles.quantiles(df.where("v < 0"), "v", [0.5]).collect() == []


# --- speed ------------------------------------------------------------------------
def test_speed_stats_missing_values(spark):
    df = spark.createDataFrame(
        [("one", 20, 5.0, 4.0, 9.0), ("gap", 20, None, 4.0, 9.0), ("gap", 21, 6.0, 5.0, 9.0),
         (None, 30, 1.0, 2.0, 3.0), (None, 31, 3.0, 6.0, 3.0), (None, 35, 8.0, 7.0, 3.0)],
        "g string, age int, diff double, trip_mph double, gm_trip_dur double")
    got = {r.g: r for r in speed.speed_stats(df, ["g"]).collect()}
    assert got["one"].sd_mph is None and got["one"].med_mph == 4.0
    assert got["gap"].mean_diff is None and got["gap"].med_diff is None and got["gap"].mean_mph == 4.5
    assert got[None].med_diff == 3.0 and got[None].med_mph == 6.0 and got[None].med_age == 31
    assert got[None].sd_diff == pytest.approx(statistics.stdev([1, 3, 8]))


def test_distinct_steps_lose_equal_lengths(spark):
    legs = spark.createDataFrame(
        [(1, 2, 100.0, 1.0)] * 3 + [(1, 2, 50.0, 0.5)] * 2 + [(1, 2, 100.0, 2.0), (3, 3, 9.0, 9.0)],
        "start_station_id int, end_station_id int, m double, minutes double")
    t = trips(spark, [(1, 1, "2015-05-26 08:00:00", 1, 2), (2, 1, "2015-05-26 17:00:00", 1, 2),
                      (3, 1, "2015-05-26 12:00:00", 1, 2), (4, 1, "2015-05-24 08:00:00", 1, 2)])
    t = t.withColumn("user_type", F.lit("Subscriber")).withColumn("gender", F.lit(None).cast("string"))
    got = speed.pair_distance(t, legs).collect()
    assert [(r.total_m, r.total_min, r["count"]) for r in got] == [(150.0, 3.5, 2)]


def test_unmatched_and_missing_gender_join(spark):
    rush = spark.createDataFrame(
        [(600.0, "Subscriber", 30, 1, 2, "Male"), (600.0, "Subscriber", 30, 8, 9, "Male")],
        "actual_trip_duration double, user_type string, age int, start_station_id int, end_station_id int, gender string")
    dist = spark.createDataFrame([(1609.344, 5.0, 1, 2, 3, "Male", "Subscriber")],
                                 "total_m double, total_min double, start_station_id int, end_station_id int, "
                                 "count long, gender string, user_type string")
    got = speed.expected_vs_actual(rush, dist).orderBy("start_station_id").collect()
    assert (got[0].diff, got[0].trip_mph, got[0].gm_mph) == (300.0, pytest.approx(6.0), pytest.approx(12.0))
    assert got[1].diff is None and got[1].trip_mph is None


def test_rollups_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, None)], "g string, k int, v double")
    got = {(r.g, r.k): (r.m, r.n) for r in speed.rollup_mean(df, "v", [["g", "k"], ["g"], []], "m").collect()}
    assert got[("a", None)] == (3.0, 2) and got[("b", 1)] == (None, 1) and got[(None, None)] == (None, 3)


# --- filters and joins -----------------------------------------------------------------
def test_holidays_by_timestamp_and_by_date(spark):
    t = trips(spark, [(1, 1, "2015-05-25 00:00:00", 1, 2), (2, 1, "2015-05-25 08:00:00", 1, 2),
                      (3, 1, "2015-05-26 08:00:00", 1, 2)])
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(conform.exclude_holidays(t, "start_time")) == [2, 3]
    assert ids(conform.exclude_holidays(t, "start_time", by_date=True)) == [3]
    table = spark.createDataFrame([(date(2015, 5, 26),)], "date date")
    assert ids(conform.exclude_holidays(t, "start_time", table, by_date=True)) == [1, 2]


def test_conform_fans_out_and_drops(spark, rows):
    stations = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id int, external_id int")
    raw = spark.createDataFrame(
        [(1, 10, 20, ""), (2, 20, 20, "NULL"), (3, 99, 20, "1980")],
        "trip_id long, start_station_id int, end_station_id int, birth_year string").selectExpr(
        "*", "60D as trip_duration", "timestamp_ntz '2015-01-01 00:00:00' as start_time",
        "timestamp_ntz '2015-01-01 00:01:00' as stop_time", "7D as bike_id", "'Subscriber' as user_type",
        "'Male' as gender")
    got = conform.conform_trips(raw, stations).select("id", "start_station_id", "end_station_id", "birth_year")
    assert rows(got) == [(1, 1, 3, None), (1, 2, 3, None), (2, 3, 3, None)]
    assert tuple(conform.unmatched_trips(raw, stations).first()) == (3, 1)


def test_stations_dedup_and_ids(spark, rows):
    raw = spark.createDataFrame([(7, "A", 41.1234561, -87.1), (7, "A", 41.1234562, -87.1), (7, "A", 41.2, -87.1),
                                 (3, "B", 41.3, -87.2)],
                                "station_id int, station_name string, latitude double, longitude double")
    got = conform.with_station_ids(conform.build_stations(raw))
    assert rows(got.select("id", "external_id", "latitude")) == [(1, 3, 41.3), (2, 7, 41.123456), (3, 7, 41.2)]


def test_gender_share_keeps_missing_gender(spark, rows):
    base = spark.createDataFrame([("S", "Male", 30, 3), ("S", None, 30, 1), ("S", "", 30, 9), ("S", "Male", None, 9)],
                                 "user_type string, gender string, age int, count long")
    got = stats.share(riders.known_age_and_gender(base), ["user_type", "gender"], "count", ["user_type"])
    assert rows(got.select("gender", "prop")) == [("Male", 75.0), (None, 25.0)]


def test_identifiable_fraction(spark):
    anon = spark.createDataFrame([("Male", 30, 1), ("Male", 30, 2), ("", 30, 1), (None, 30, 1)],
                                 "gender string, age int, count long")
    got = riders.identifiability(anon).collect()
    assert [(r.gender, r.total, r.fraction) for r in got] == [("Male", 2, 0.5)]


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([9, 8, 8, 7])], "i int, v double")
    assert sorted(r.i for r in stats.top_n(df, 2, "v").collect()) == [0, 1, 2]


def test_lag_modes(spark, rows):
    g = spark.createDataFrame([(date(2015, 1, 1), 4, 1, 10), (date(2015, 1, 1), 4, 2, 100), (date(2015, 1, 2), 5, 1, 1000)],
                              "date date, weekday int, start_station_id int, total_trips long")
    coded = weather.with_lag_generation(g).select("date", "start_station_id", "lag_total_trips")
    assert [r[2] for r in rows(coded)] == [None, 10, None]
    meant = weather.with_lag_generation(g, across_stations=False).select("date", "start_station_id", "lag_log_total_trips")
    assert [r[2] for r in rows(meant)] == [None, None, 1.0]


def test_pair_summary_metamorphic(spark):
    rnd = random.Random(5)
    base = datetime(2015, 1, 1)
    t = trips(spark, [(i, i % 5, str(base + timedelta(minutes=rnd.randrange(40000))), rnd.randrange(4), rnd.randrange(4))
                      for i in range(300)])
    pairs = flows.station_pair_hourly(t)
    assert pairs.agg(F.sum("trips")).first()[0] == 300
    weekdays = flows.station_pair_hourly(t, weekdays_only=True)
    assert weekdays.agg(F.sum("trips")).first()[0] == t.where(F.dayofweek("start_time").between(2, 6)).count()


def test_fit_generation_recovers_coefficients(spark):
    rnd = random.Random(1)
    data = [(x, rnd.random() < 0.3, z, 1.5 + 2.0 * x - 0.5 * z) for x, z in
            ((rnd.random(), rnd.random()) for _ in range(200))]
    df = spark.createDataFrame(data + [(None, True, 1.0, 1.0)], "x double, b boolean, z double, y double")
    got = {r.term: r.estimate for r in weather.fit_generation(df, None, ["x", "b", "z"], "y").collect()}
    assert got == {"(Intercept)": pytest.approx(1.5), "x": pytest.approx(2.0), "b": pytest.approx(0.0, abs=1e-9),
                   "z": pytest.approx(-0.5)}


# --- polygons -----------------------------------------------------------------------------
SQUARE = [(1, "sq", 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1)])]
HOLE = [(1, "sq", 1, i, x, y) for i, (x, y) in enumerate([(0.04, 0.04), (0.06, 0.04), (0.06, 0.06), (0.04, 0.06)])]
POINTS = {"inside": (0.02, 0.03), "hole": (0.05, 0.05), "edge": (0.1, 0.05), "vertex": (0.0, 0.0),
          "outside": (0.2, 0.05), "level with a vertex": (-0.01, 0.1), "none": (None, 0.05)}


def test_points_in_polygon(spark):
    v = spark.createDataFrame([(g, n, r, p, float(x), float(y)) for g, n, r, p, x, y in SQUARE + HOLE],
                              "gid int, name string, ring int, pos int, x double, y double")
    pts = spark.createDataFrame([(k, *xy) for k, xy in POINTS.items()], "k string, lon double, lat double")
    strict = {r.k: r.gid for r in spatial.assign_area(pts, v, "lon", "lat", "k").collect()}
    assert {k for k, g in strict.items() if g == 1} == {"inside"} and set(strict) == set(POINTS)
    touching = spatial.spatial_join(pts, v, "lon", "lat", "inner", keep=["gid", "name"]).collect()
    assert {r.k for r in touching} == {"inside", "edge", "vertex"}
    assert spatial.spatial_join(pts, v, "lon", "lat", "left").count() == len(POINTS)


@pytest.mark.parametrize("cell", [0.003, 0.01, 1.0])
def test_cells_do_not_change_the_answer(spark, cell):
    rnd = random.Random(2)
    polys, tri = [], {}
    for g in range(8):
        cx, cy = rnd.random() * 0.2, rnd.random() * 0.2
        tri[g] = [(cx + rnd.uniform(-.05, .05), cy + rnd.uniform(-.05, .05)) for _ in range(3)]
        polys += [(g, f"p{g}", 0, i, x, y) for i, (x, y) in enumerate(tri[g])]
    pts = [(i, rnd.random() * 0.2, rnd.random() * 0.2) for i in range(150)]

    def holds(t, x, y):
        s = [(t[(i + 1) % 3][0] - t[i][0]) * (y - t[i][1]) - (t[(i + 1) % 3][1] - t[i][1]) * (x - t[i][0]) for i in range(3)]
        return all(v > 0 for v in s) or all(v < 0 for v in s)

    want = {(i, g) for i, x, y in pts for g, t in tri.items() if holds(t, x, y)}
    v = spark.createDataFrame(polys, "gid int, name string, ring int, pos int, x double, y double")
    p = spark.createDataFrame(pts, "i int, lon double, lat double")
    got = spatial.spatial_join(p, v, "lon", "lat", "inner", cell=cell).collect()
    assert {(r.i, r.gid) for r in got} == want


# --- routes ---------------------------------------------------------------------------------
def test_route_steps_to_segments(spark, rows):
    line = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    steps = spark.createDataFrame([(1, 2, 0, line, 100.0, 90.0), (1, 2, 1, line, 50.0, 60.0)],
                                  "id_start int, id_end int, step_no int, polyline string, distance_m double, duration_s double")
    v = routes.route_vertices(steps)
    assert v.count() == 6 and {r.minutes for r in v.collect()} == {1.5, 1.0}
    for slices in (None, F.lit(0)):
        seg = routes.segments(v, slice_of=slices)
        ends = [r.end_lat for r in seg.collect()]
        assert ends.count(None) == 1 and len(ends) == 6
        joint = [r for r in seg.collect() if r.m == 100.0 and round(r.start_lat, 3) == 43.252]
        assert round(joint[0].end_lat, 5) == 38.5       # the next step's first vertex


def test_density_integrates_to_one(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.gauss(0, 1), rnd.gauss(5, 2), 1.0 + i % 3) for i in range(300)],
                               "x double, y double, w double")
    z = stats.weighted_kde(df, "x", "y", "w", 25).collect()
    xs, ys = sorted({r.x for r in z}), sorted({r.y for r in z})
    area = (xs[1] - xs[0]) * (ys[1] - ys[0])
    assert len(z) == 625 and sum(r.z for r in z) * area == pytest.approx(1.0, abs=0.05)


def test_bins_keep_every_row(spark):
    df = spark.createDataFrame([(float(i % 17), float(i % 23), "g") for i in range(391)], "x double, y double, g string")
    assert stats.hexbin(df, "x", "y", by=["g"]).agg(F.sum("count")).first()[0] == 391
    h = stats.histogram(df, "x", 8).orderBy("bin").collect()
    assert [r.bin for r in h] == list(range(8)) and sum(r["count"] for r in h) == 391
    flat = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert stats.histogram(flat, "x").first()["count"] == 3 and stats.hexbin(flat, "x", "y").first()["count"] == 3


def test_steps_are_distinct_as_they_are_and_sums_do_not_overflow(spark):
    t = trips(spark, [(1, 1, "2015-05-26 08:00:00", 1, 2)]).withColumns({"user_type": F.lit("Subscriber"), "gender": F.lit("Male")})
    legs = spark.createDataFrame([(1, 2, 12.3456781, 1.5e6), (1, 2, 12.3456784, 1.5e6), (1, 2, 12.3456784, 2e6)],
                                 "start_station_id int, end_station_id int, m double, minutes double")
    got = speed.pair_distance(t, legs).first()
    assert got.total_m == pytest.approx(24.6913565, abs=1e-9) and got.total_min == 3.5e6


def test_moments_give_the_fit(spark):
    rnd = random.Random(8)
    names = ["lag_log_total_trips", "freeze", "cold_0_to_10", "cool_10_to_20", "warm_20_to_30", "precip", "snow_depth_mm"]
    rows = []
    for _ in range(400):
        x = [rnd.gauss(0, 1) for _ in names]
        rows.append((2017, *x, 1.0 + sum((i + 1) * v for i, v in enumerate(x)) + rnd.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "year int, " + ", ".join(f"{n} double" for n in [*names, "log_total_trips"]))
    m = {(r.a, r.b): r.value for r in weather.generation_moments(df).collect()}
    terms = ["1", *names]
    both = np.array([[m.get((a, b), m.get((b, a))) for b in terms] for a in terms])
    want = np.linalg.solve(both, [m[a, "log_total_trips"] for a in terms])
    got = {r.term: r.estimate for r in weather.fit_generation(df).collect()}
    assert [got["(Intercept)"], *[got[n] for n in names]] == pytest.approx(want.tolist(), abs=1e-6)


def test_cells_of_a_large_polygon_hold_few_edges(spark):
    n = 2000
    ring = [(1, "c", 0, k, 2 * math.cos(2 * math.pi * k / n), 2 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    v = spark.createDataFrame(ring, "gid int, name string, ring int, pos int, x double, y double")
    cells = spatial.polygon_cells(v, 0.05)
    total = cells.agg(F.sum(F.size("edges")).alias("edges"), F.max(F.size("edges")).alias("most"), F.count("*").alias("n")).first()
    assert total.edges < 4 * n and total.most < 60
    rnd = random.Random(9)
    pts = [(i, rnd.uniform(-2.2, 2.2), rnd.uniform(-2.2, 2.2)) for i in range(400)] + [(400, 2.0, 0.0), (401, None, 0.0), (402, 0.0, 0.0)]
    p = spark.createDataFrame(pts, "i int, lon double, lat double")
    got = {r.i for r in spatial.spatial_join(p, v, "lon", "lat", cell=0.05).collect()}
    apothem = 2 * math.cos(math.pi / n)
    sure = {i for i, x, y in pts if x is not None and math.hypot(x, y) < apothem} | {400}
    assert got == sure | {i for i in got if apothem <= math.hypot(pts[i][1], pts[i][2]) <= 2}
    areas = spatial.areas_with_points(p.where("i < 0"), v, "lon", "lat")
    assert areas.count() == 1 and areas.first().i is None


def test_density_and_bins_aggregate_by_hash(spark):
    """No aggregate sorts the repeated rows: a struct carried through it would."""
    from veloframe.operators import stats
    df = spark.range(50).selectExpr("cast(id as double) as x", "cast(id * id % 17 as double) as y", "1e0 as w")
    for out in (stats.weighted_kde(df, "x", "y", "w", 5), stats.hexbin(df, "x", "y", 5), stats.histogram(df, "x", 5)):
        assert "SortAggregate" not in out._jdf.queryExecution().toString()
        assert out.count() > 0


def test_segments_work_on_stretches(spark, monkeypatch):
    """A slice is a stretch of steps: a slice per step would shuffle a first row for each."""
    v = spark.range(4000).selectExpr("1 as id_start", "cast(null as int) as id_end", "id div 2 as step_no", "id % 2 as vertex_no",
                                     "cast(id as double) as lat", "0e0 as lon", "1e0 as m", "1e0 as minutes")
    seen, plain = [], routes.with_next
    monkeypatch.setattr(routes, "with_next", lambda df, slice_of, **k: (seen.append(df.select(slice_of).distinct().count()), plain(df, slice_of=slice_of, **k))[1])
    for stretch in (1 << 16, 7):
        monkeypatch.setattr(routes, "STRETCH", stretch)
        got = {r.start_lat: r.end_lat for r in routes.segments(v).collect()}
        assert got == {float(k): float(k + 1) if k < 3999 else None for k in range(4000)}
    assert seen == [1, 286]
