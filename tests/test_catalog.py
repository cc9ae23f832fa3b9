"""Registered queries against DuckDB.  All of them with CATALOG=all."""

import os

import duckdb
import pytest

from catalog import QUERIES
from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

SF = os.environ.get("CATALOG_SF", "0.01")
SAMPLE = ["transport_by_area_hour", "bike_chain_hot", "active_bikes_28d", "rolling_28_rows", "od_area_hourly",
          "user_hour_by_daytype", "pair_distance", "speed_by_age", "gap_rollups", "anon_hourly", "gender_share",
          "assign_tract", "spatial_lookup", "weighted_kde", "hexbin", "route_vertices", "segment_lead_hot",
          "daily_weather", "weather_by_temp", "lag_generation", "top_n_intended", "read_trips", "union_files",
          "read_boundaries", "quantile_duration_by_station", "bike_chain_null_starts", "quantile_outliers",
          "pair_distance_fine_steps", "heat_map", "read_boundary_collection", "trip_generation_moments",
          "areas_with_points", "weather_by_humidity", "staging_emptied"]
NAMES = list(QUERIES) if os.environ.get("CATALOG") == "all" else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, _, _ = compare(spark, con, name, f"/root/testdata/sf{SF}")
    assert status == ("ok" if name in oracle_sql() else "rows only"), status


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["commarea", "hour", "perc", "total"]


def test_every_sql_names_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(oracle_sql()) == {"trip_generation_lm"}
