"""Files in, tables out."""

import gzip
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from veloframe.plans import heatmap, warehouse
from veloframe.sources import readers, writers

TRIPS = "trip_id,start_time,stop_time,bikeid,tripduration,from_id,from_name,to_id,to_name,usertype,gender,birthyear\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def trip_files(root):
    write(root / "a" / "q1.csv", TRIPS + "1,2015-05-26 08:00:00,2015-05-26 08:10:00,7,600,10,A,20,B,Subscriber,Male,1980\n"
          + '2,2015-05-26 09:00:00,2015-05-26 09:10:00,7,600,20,B,10,A,Customer,"",NULL\n')
    write(root / "b" / "deep" / "q2.csv", TRIPS + "3,5/27/2015 8:00,5/27/2015 8:05,7,300,10,A,20,B,Subscriber,,\n"
          + '4,5/27/2015 9:00,5/27/2015 9:05,7,300,10,A,99,C,Subscriber,Female,""\n')


def test_trip_files_with_own_headers(spark, tmp_path):
    trip_files(tmp_path)
    got = {r.trip_id: r for r in readers.read_trips(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[3].start_time == datetime(2015, 5, 27, 8) and got[1].start_time == datetime(2015, 5, 26, 8)
    assert got[2].gender == "" and got[3].gender is None        # quoted against unquoted empty
    assert got[4].birth_year == "" and got[3].birth_year is None


def test_legs_na(spark, tmp_path):
    write(tmp_path / "legs.csv", "id_start,id_end,start_lat,end_lat,start_lon,end_lon,m,minutes\n"
          "1,2,41.1,41.2,-87.1,-87.2,100,1.5\n1,2,41.2,NA,-87.2,NA,100,1.5\n")
    got = readers.read_legs(spark, str(tmp_path)).orderBy("start_lat").collect()
    assert got[0].end_lat == 41.2 and got[1].end_lat is None and got[1].end_lon is None


def boundary(path, gid, name, rings, multi=False):
    write(path, json.dumps({"type": "Feature", "properties": {"gid": gid, "community": name},
                            "geometry": {"type": "MultiPolygon" if multi else "Polygon",
                                         "coordinates": [rings] if multi else rings}}) + "\n")


def test_boundaries(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    boundary(tmp_path / "a.json", 1, "LOOP", [ring, ring])
    boundary(tmp_path / "b.json", 2, "WEST", [ring], multi=True)
    got = readers.read_boundaries(spark, str(tmp_path))
    assert {(r.gid, r.name, r.ring) for r in got.collect()} == {(1, "LOOP", 0), (1, "LOOP", 1), (2, "WEST", 0)}
    assert got.count() == 12


def test_warehouse_end_to_end(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    trip_files(raw / "trips")
    write(raw / "stations" / "s.csv", "id,name,city,latitude,longitude,dpcapacity,online_date,\n"
          "10,A,Chicago,0.05,0.05,11,6/10/2013,\n20,B,Chicago,0.05,0.55,11,2013-06-10,\n20,B,Chicago,0.05,0.55,11,2013-06-10,\n")
    write(raw / "weather" / "w.csv", "date,average_temp,visibility,average_wind_speed,max_temp,min_temp,precip,dewp,"
          "snow_depth_mm,fog,rain_drizzle,snow_ice,hail,thunder,tornado_funnel,relative_humidity\n"
          "2015-05-26,20,10,3,25,15,0,283,0,false,true,false,false,false,false,60\n")
    box = lambda x: [[[x, 0], [x + .1, 0], [x + .1, .1], [x, .1], [x, 0]]]
    boundary(raw / "tracts" / "t.json", 5, "T5", box(0.0))
    boundary(raw / "areas" / "c.json", 8, "LOOP", box(0.5))
    paths = warehouse.build_warehouse(spark, {"trips": str(raw / "trips"), "stations": str(raw / "stations"),
                                              "weather": str(raw / "weather"), "tracts": str(raw / "tracts"),
                                              "communities": str(raw / "areas")}, str(out))
    table = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert len(table) == 13
    assert [(r.id, r.external_id, r.chict2010_gid, r.commid, r.commarea)
            for r in table["stations"].orderBy("id").collect()] == [(1, 10, 5, None, None), (2, 20, None, 8, "LOOP")]
    assert table["trips"].count() == 3                       # trip 4 ends at an unknown station
    plan = table["trips"].where(F.col("start_date") == F.lit("2015-05-27").cast("date"))
    assert "PartitionFilters: [isnotnull(start_date" in plan._jdf.queryExecution().executedPlan().toString()
    day = table["daily_agg_weather"].first()
    assert (day.date, day.trips, day.dow, day.holiday) == (date(2015, 5, 26), 2, 2, False)
    assert {(r.end_station_id, r.total_drop_offs, r.transported_to_other_station)
            for r in table["station_aggregates"].collect()} == {(2, 1, 0), (1, 1, 0)}
    assert table["monthly_active_bikes"].where("date = '2015-06-23'").first().bikes == 1
    assert table["monthly_active_bikes"].where("date = '2015-06-24'").count() == 0


def test_heat_map_is_drawn_busy_last(spark):
    steps = spark.createDataFrame([(1, 2, 0, "_p~iF~ps|U_ulLnnqC_mqNvxq`@", 100.0, 90.0), (2, 1, 0, "_p~iF~ps|U_ulLnnqC", 50.0, 60.0)],
                                  "id_start int, id_end int, step_no int, polyline string, distance_m double, duration_s double")
    trips = spark.createDataFrame([(1, 2, "2015-01-01")] * 3 + [(2, 1, "2015-01-01"), (1, 1, "2015-01-01")],
                                  "start_station_id int, end_station_id int, d string").withColumn(
        "start_time", F.col("d").cast("timestamp_ntz"))
    got = heatmap.heat_map(trips, heatmap.route_legs(steps)).collect()
    assert [(r.grp, r["count"], r.num_days) for r in got] == [("2.1", 1, 1)] * 2 + [("1.2", 3, 1)] * 3


def test_files_of_any_name_are_read(spark, tmp_path):
    legs = "start_station_id,end_station_id,start_lat,end_lat,start_lon,end_lon,m,minutes\n1,2,0,0,0,0,5,NA\n"
    for name in ("legs.txt", "deep/legs.CSV", "legs.csv"):
        write(tmp_path / name, legs)
    (tmp_path / "legs.csv.gz").write_bytes(gzip.compress(legs.encode()))
    assert readers.read_legs(spark, str(tmp_path)).count() == 4
    assert readers.read_legs(spark, str(tmp_path), names="*.csv").count() == 1


def feature(kind, coordinates):
    return {"type": "Feature", "properties": {"gid": "1", "community": "A"}, "geometry": {"type": kind, "coordinates": coordinates}}


BOX = [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.2]]]


@pytest.mark.parametrize("indent", [None, 2])
def test_collections_in_both_forms(spark, tmp_path, rows, indent):
    both = [feature("Polygon", BOX), feature("MultiPolygon", [BOX, BOX])]
    write(tmp_path / "c" / "c.json", json.dumps({"type": "FeatureCollection", "features": both}, indent=indent))
    write(tmp_path / "l" / "l.json", "\n".join(json.dumps(f) for f in both) + "\n")
    got = rows(readers.read_boundaries(spark, str(tmp_path / "c")))
    assert got == rows(readers.read_boundaries(spark, str(tmp_path / "l"))) and len(got) == 24
    assert {r[2] for r in got} == {0, 1, 2, 3}


@pytest.mark.parametrize("bad", ['{"type": "Feature", "prop', json.dumps(feature("GeometryCollection", [])), json.dumps(feature("Polygon", "x")),
                                 '{"type": "Feature", "properties": {}, "geometry": null}'])
def test_broken_boundaries_raise(spark, tmp_path, bad):
    write(tmp_path / "b.json", json.dumps(feature("Polygon", BOX)) + "\n" + bad + "\n")
    with pytest.raises(Exception):
        readers.read_boundaries(spark, str(tmp_path)).collect()


def test_emptied_staging_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(5).selectExpr("id", "'x' as t").write.parquet(path)
    writers.empty_staging(spark, path)
    got = spark.read.parquet(path)
    assert got.count() == 0 and got.columns == ["id", "t"]


def test_collections_lie_in_several_files(spark, monkeypatch):
    """No task holds all features: a collection has a bounded number of ids."""
    from catalog import places
    monkeypatch.setattr(places, "COLLECTION", 16, raising=False)
    d = "/root/testdata/sf0.01"
    got = places.geojson(spark, d, collection=True)
    assert len(got.inputFiles()) > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, places.geojson(spark, d).collect()))
