"""Trip speed against expected route time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import buckets, units
from ..functions.holidays import HOLIDAYS
from ..session import saved
from .conform import (exclude_holidays, known_subscribers, not_dependent, not_round_trip,
                      rush_hour_weekdays)
from .joins import null_safe_join
from .quantiles import quantiles
from .riders import with_age


def _commute(trips: DataFrame, holidays, by_date: bool) -> DataFrame:
    return exclude_holidays(rush_hour_weekdays(not_round_trip(trips)), "start_time", holidays, by_date)


def pair_distance(trips: DataFrame, legs: DataFrame, holidays=HOLIDAYS,
                  by_date: bool = False) -> DataFrame:
    """Expected route length and time for each pair and rider group.

    The length is the sum of the pair's *distinct* step lengths: every polyline
    vertex repeats its step's length, and distinct undoes that (two equal steps
    of one route count once).  The repeats go first, before anything is shuffled.
    The sum depends on the pair alone, so legs are reduced to one row per pair
    before the join with the trip counts.  Lengths and times are made distinct as they
    are; only then each is summed as a decimal of 26 digits before and 12 behind the
    point, so the sum does not depend on the order of the rows.
    """
    counts = (not_dependent(_commute(trips, holidays, by_date))
              .groupBy("start_station_id", "end_station_id", "user_type", "gender")
              .agg(F.count("*").alias("count")))
    measures = F.array(F.struct(F.lit("m").alias("what"), F.col("m").cast("double").alias("v")),
                       F.struct(F.lit("min").alias("what"), F.col("minutes").cast("double").alias("v")))
    steps = (not_round_trip(legs).select("start_station_id", "end_station_id", F.explode(measures).alias("x"))
             .select("start_station_id", "end_station_id", "x.what", "x.v").distinct())
    exact = F.col("v").cast("decimal(38,12)")
    routes = (steps.groupBy("start_station_id", "end_station_id")
              .agg(F.sum(F.when(F.col("what") == "m", exact)).cast("double").alias("total_m"),
                   F.sum(F.when(F.col("what") == "min", exact)).cast("double").alias("total_min")))
    return (routes.join(counts, ["start_station_id", "end_station_id"])
            .select("total_m", "total_min", "start_station_id", "end_station_id",
                    "count", "gender", "user_type"))


def rush_hour_trips(trips: DataFrame, holidays=HOLIDAYS, by_date: bool = False) -> DataFrame:
    return (with_age(known_subscribers(_commute(trips, holidays, by_date)))
            .select(F.col("trip_duration").alias("actual_trip_duration"), "user_type", "age",
                    "start_station_id", "end_station_id", "gender"))


def expected_vs_actual(rush: DataFrame, pair_dist: DataFrame) -> DataFrame:
    """Rush-hour trips with expected time, gap and both speeds (left join)."""
    expected = pair_dist.select(
        "start_station_id", "end_station_id", "user_type", "gender", "total_m",
        (F.col("total_min") * F.lit(60.0)).alias("gm_trip_dur"))
    joined = null_safe_join(rush, expected,
                            ["start_station_id", "end_station_id", "user_type", "gender"], "left")
    miles = units.miles(F.col("total_m"))
    return (joined.where(F.col("gender").isin("Male", "Female"))
            .withColumn("diff", F.col("actual_trip_duration") - F.col("gm_trip_dur"))
            .withColumn("dist_miles", miles)
            .withColumn("trip_mph", units.mph(F.col("dist_miles"), F.col("actual_trip_duration")))
            .withColumn("gm_mph", units.mph(F.col("dist_miles"), F.col("gm_trip_dur"))))


def with_buckets(df: DataFrame) -> DataFrame:
    return (df.withColumn("age_bucket", buckets.cut(F.col("age"), buckets.AGE_EDGES))
            .withColumn("dist_bucket", buckets.cut(F.col("dist_miles"), buckets.DISTANCE_EDGES,
                                                   buckets.DISTANCE_LABELS))
            .withColumn("expected_bucket", buckets.cut(F.col("gm_trip_dur"), buckets.EXPECTED_EDGES,
                                                       buckets.EXPECTED_LABELS)))


def _whole(agg, value: str):
    """NULL unless every row of the group has the value."""
    return F.when(F.count(value) == F.count("*"), agg)


def speed_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, median and sd of gap and speed, count, expected time and age.

    The few columns needed are saved once, since two aggregates read them and the
    join above is the costly part.  Means and deviations are one partial aggregate.  Medians of gap and speed
    come from the distributed quantile, both in one pass over (group, value)
    counts, so a group of any size is never held by one task.
    """
    df = saved(df.select(*by, "diff", "trip_mph", "gm_trip_dur", *([] if "age" in by else ["age"])),
               "speed-rows")
    base = df.groupBy(*by).agg(
        *[_whole(fn(c), c).alias(f"{pre}_{out}")
          for c, out in (("diff", "diff"), ("trip_mph", "mph"))
          for fn, pre in ((F.avg, "mean"), (F.stddev_samp, "sd"))],
        F.count("*").alias("count"),
        _whole(F.avg("gm_trip_dur"), "gm_trip_dur").alias("mean_exp"),
        _whole(F.avg("age"), "age").alias("mean_age"),
        _whole(F.percentile("age", F.lit(0.5)), "age").alias("med_age"))
    long = df.select(*by, F.explode(F.array(
        F.struct(F.lit("diff").alias("what"), F.col("diff").cast("double").alias("v")),
        F.struct(F.lit("mph").alias("what"), F.col("trip_mph").cast("double").alias("v")))).alias("_p")
    ).select(*by, "_p.what", "_p.v")
    med = quantiles(long, "v", [0.5], by=[*by, "what"])
    wide = med.groupBy(*by).agg(
        F.max(F.when(F.col("what") == "diff", F.col("value"))).alias("_md"),
        F.max(F.when(F.col("what") == "mph", F.col("value"))).alias("_mm"))
    return null_safe_join(base, wide, list(by), "left").select(
        *by, "mean_diff", F.when(F.col("mean_diff").isNotNull(), F.col("_md")).alias("med_diff"),
        "sd_diff", "mean_mph",
        F.when(F.col("mean_mph").isNotNull(), F.col("_mm")).alias("med_mph"), "sd_mph",
        "count", "mean_exp", "mean_age", "med_age")


def speed_by_distance_bucket(df: DataFrame) -> DataFrame:
    return df.groupBy("dist_bucket").agg(
        (F.avg("diff") / F.lit(60.0)).alias("mean_diff"),
        (F.stddev_samp("diff") / F.lit(60.0)).alias("sd_diff"),
        F.avg("trip_mph").alias("mean_mph"), F.stddev_samp("trip_mph").alias("sd_mph"))


def unpivot_speed(stats: DataFrame) -> DataFrame:
    ids = [c for c in stats.columns if c not in ("mean_mph", "med_mph", "sd_mph")]
    return stats.unpivot(ids, ["mean_mph", "med_mph", "sd_mph"], "speed_stats", "speed")


def unpivot_gap(stats: DataFrame) -> DataFrame:
    ids = [c for c in stats.columns if c not in ("mean_diff", "med_diff", "sd_diff")]
    return stats.unpivot(ids, ["mean_diff", "med_diff", "sd_diff"], "diff_stats", "diff")


def rollup_mean(long: DataFrame, value: str, sets: Sequence[Sequence[str]], name: str,
                scale: float = 1.0) -> DataFrame:
    """Means of one column over several groupings in a single pass.

    ``long`` holds mean, median and sd rows; averaging all of them is the
    literal behaviour, filter to one statistic first for the intended one.  A
    grouping with any missing value gives NULL.
    """
    cols = sorted({c for s in sets for c in s})
    return (long.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
            .agg((_whole(F.avg(value), value) / F.lit(scale)).alias(name),
                 F.count("*").alias("n"), F.grouping_id().alias("level")))


def gap_by_age(df: DataFrame) -> DataFrame:
    return df.groupBy("age", "gender").agg(F.count("*").alias("count"),
                                           F.avg("diff").alias("mean_diff"))


def speed_by_age(df: DataFrame) -> DataFrame:
    return df.where(F.col("gender") != "").groupBy("age", "gender").agg(
        F.count("*").alias("count"), F.avg("trip_mph").alias("mean_speed"))


def distance_profile(df: DataFrame) -> DataFrame:
    """Gap and speed by route length to 0.1 m and gender."""
    near = F.bround("total_m", 1)
    return (df.where(F.col("gender") != "").withColumn("nearest_dist_m", near)
            .groupBy("nearest_dist_m", "gender")
            .agg(F.count("*").alias("count"), F.avg("nearest_dist_m").alias("mean_dist"),
                 F.avg("diff").alias("mean_diff"), F.avg("trip_mph").alias("mean_speed")))
