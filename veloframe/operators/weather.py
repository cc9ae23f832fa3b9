"""Trips against daily weather, and the trip-generation models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefns
from ..functions.holidays import HOLIDAYS
from ..functions.weather import perceived_temp, temp_bands
from .conform import with_holiday
from .flows import daily_trips
from .sequence import with_previous


def daily_weather(trips: DataFrame, weather: DataFrame,
                  holidays: Sequence[str] | DataFrame = HOLIDAYS) -> DataFrame:
    """Daily trips with that day's weather and calendar columns.  Days without a
    weather row drop."""
    day = F.col("date")
    days = (daily_trips(trips).join(weather, "date")
            .withColumn("dow", timefns.pg_dow(day)).withColumn("month", F.month(day))
            .withColumn("year", F.year(day)))
    return with_holiday(days, holidays=holidays)


def with_perceived_temp(df: DataFrame, variant: str = "a") -> DataFrame:
    return df.withColumn("perceived_max_temp", perceived_temp(variant))


def with_temp_bands(df: DataFrame, temp: str = "max_temp", with_hot: bool = False) -> DataFrame:
    return df.withColumns(temp_bands(F.col(temp), with_hot))


def weather_response(days: DataFrame, bucket: Column, bucket_name: str, value: str | None = None,
                     value_name: str = "avg_value") -> DataFrame:
    """Days, mean of the weather value, mean trips and its standard error, by bucket."""
    extra = [F.avg(value).alias(value_name)] if value else []
    return (days.where(F.col("weekday_not_holiday")).groupBy(bucket.alias(bucket_name))
            .agg(F.count("*").alias("count"), *extra, F.avg("trips").alias("avg_trips"),
                 (F.stddev_samp("trips") / F.sqrt(F.count("*"))).alias("se_trips")))


def station_day_weather(generation: DataFrame, days: DataFrame) -> DataFrame:
    """Station-days with the weather of their date (left join)."""
    return generation.join(days.drop("trips"), "date", "left")


def with_lag_generation(generation: DataFrame, across_stations: bool = True) -> DataFrame:
    """Previous total and its log10.

    The literal form lags over the stations of one day; with
    ``across_stations=False`` over the days of one station, as was meant.
    """
    by, order = ((["date", "weekday"], ["start_station_id"]) if across_stations
                 else (["start_station_id"], ["date"]))
    logged = generation.withColumn("log_total_trips", F.log10("total_trips"))
    return with_previous(logged, by, order, {"lag_total_trips": "total_trips",
                                             "lag_log_total_trips": "log_total_trips"})


GENERATION_FEATURES = ("lag_log_total_trips", "freeze", "cold_0_to_10", "cool_10_to_20",
                       "warm_20_to_30", "precip", "snow_depth_mm")


def generation_moments(df: DataFrame, year: int | None = 2017,
                       features: Sequence[str] = GENERATION_FEATURES,
                       label: str = "log_total_trips") -> DataFrame:
    """The sums of products (a, b, value) of the constant, the features and the label that the
    least-squares fit rests on, in one pass; rows with a missing value take no part."""
    rows = df if year is None else df.where(F.col("year") == year)
    terms = [*features, label]
    data = rows.select(F.lit(1.0).alias("1"), *[F.col(c).cast("double").alias(c) for c in terms]).dropna()
    pairs = [(a, b) for i, a in enumerate(["1", *terms]) for b in ["1", *terms][i:]]
    sums = data.agg(*[F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("value"))
                                           for i, (a, b) in enumerate(pairs)])).alias("m")).select("m.*")


def fit_generation(df: DataFrame, year: int | None = 2017,
                   features: Sequence[str] = GENERATION_FEATURES,
                   label: str = "log_total_trips") -> DataFrame:
    """Least-squares trip generation for one year; one row per term.

    Fitting is an action: Spark sums the normal equations over the cluster and
    the driver solves a system with one row per term.  Terms that depend linearly on each
    other share their weight in the shortest solution's way only as far as the solver
    regularises; drop one of them for estimates that can be read singly.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df if year is None else df.where(F.col("year") == year)
    data = rows.select(F.col(label).cast("double").alias("label"),
                       *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    model = LinearRegression(solver="normal", standardization=False).fit(
        vectors.select("features", "label"))
    terms = [("(Intercept)", float(model.intercept))]
    terms += [(c, float(b)) for c, b in zip(features, model.coefficients)]
    return df.sparkSession.createDataFrame(terms, "term string, estimate double")
