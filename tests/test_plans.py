"""Shapes of physical plans."""

import re

import pytest

from __spark_entry__ import queries

D = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "active_bikes_28d", "assign_tract", "spatial_lookup", "weighted_kde", "grid_cross_join", "top_n_intended",
    "top_percentile_filter", "expected_vs_actual", "route_segments", "od_area_hourly", "histogram", "hexbin",
    "break_labels", "bike_chain", "trailing_range_join", "share_of_total"])
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "BatchEvalPython" not in text


def test_scans_read_only_what_they_need(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan(spark, "daily_trips")
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_shipdate:\w+>", plan(spark, "active_bikes_28d"))


def test_filters_reach_the_scan(spark):
    text = plan(spark, "not_dependent")
    assert "event_type" in re.search(r"DataFilters: \[([^\]]*)\]", text).group(1)


def test_stored_summary_is_pruned_by_date(spark):
    text = plan(spark, "scan_summary")
    assert re.search(r"PartitionFilters: \[[^\]]*date", text)
    assert re.search(r"ReadSchema: struct<hour:int,trips:bigint>", text)


def test_trips_are_counted_per_pair_before_legs_join(spark):
    text = plan(spark, "pair_distance")
    join = re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", text).start()
    assert text.count("HashAggregate", join) >= 4            # both inputs are aggregated below the join


@pytest.mark.parametrize("name", ["bike_chain", "segment_lead"])
def test_next_rows_read_their_input_twice_and_shuffle_it_once(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"Scan parquet", text)) <= 2
    join = re.search(r"SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", text)
    left = text[join.start():].split("Window", 2)[1]
    assert left.count("Exchange hashpartitioning") >= 1


@pytest.mark.parametrize("name,most", [("union_tagged", 8), ("surrogate_id", 3), ("quantile_distance", 2), ("quantile_weather", 2)])
def test_shared_inputs_are_read_once(spark, name, most):
    assert len(re.findall(r"Scan parquet", plan(spark, name))) <= most
