"""Rider make-up and re-identification risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, timefns
from .conform import known_subscribers, not_dependent


def with_age(trips: DataFrame) -> DataFrame:
    return trips.withColumn("age", cleaning.age_at(F.col("start_time"), F.col("birth_year")))


def anon_counts(trips: DataFrame, unit: str = "hour") -> DataFrame:
    """Trips by rounded start, start station, gender and age of known subscribers."""
    when = {"hour": timefns.round_to_hour, "day": timefns.round_to_day}[unit](F.col("start_time"))
    return (with_age(known_subscribers(trips))
            .groupBy(when.alias(f"round_{unit}"), "start_station_id", "gender", "age")
            .agg(F.count("*").alias("count")))


def identifiability(anon: DataFrame, by: Sequence[str] = ("gender", "age")) -> DataFrame:
    """Share of groups with a single trip, for non-blank genders."""
    return (anon.where(F.col("gender") != "").groupBy(*by)
            .agg(F.count("*").alias("total"),
                 F.avg((F.col("count") == 1).cast("double")).alias("fraction")))


def identifiability_mean(fractions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return fractions.groupBy(*by).agg(F.avg("fraction").alias("mean_fraction"))


def rider_base(trips: DataFrame) -> DataFrame:
    """Trips per user type, gender, start time and birth year, with the age."""
    return (with_age(not_dependent(trips))
            .groupBy("user_type", "gender", "start_time", "birth_year", "age")
            .agg(F.count("*").alias("count"))
            .drop("start_time", "birth_year"))


def known_age_and_gender(base: DataFrame) -> DataFrame:
    """Rows with an age whose gender is not blank; a missing gender passes."""
    blank = F.coalesce(F.col("gender").isin("", "NA"), F.lit(False))
    return base.where(F.col("age").isNotNull() & ~blank)


def age_stats(base: DataFrame) -> DataFrame:
    """Rows, mean and median age by user type and gender.  Counts rows of the
    base, not trips.  Ages are few distinct values, so ``percentile`` is small."""
    rows = base.where(F.col("age").isNotNull() & F.col("gender").isin("Female", "Male"))
    return rows.groupBy("user_type", "gender").agg(
        F.count("*").alias("count"), F.avg("age").alias("mean_age"),
        F.percentile("age", F.lit(0.5)).alias("median_age"))
