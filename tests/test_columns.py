"""Column functions on hand-made values."""

import math
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veloframe.functions import buckets, cleaning, timefns, units, weather
from veloframe.functions.polyline import decode_polyline
from veloframe.sources.readers import parse_date, parse_timestamp

POLYLINE = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def ts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))


def one(df):
    return [r[0] for r in df.collect()]


def test_nearest_hour_and_day(spark):
    df = ts(spark, "2015-05-25 08:29:59", "2015-05-25 08:30:00", "2015-05-25 23:45:00",
            "2015-05-25 11:59:59", "2015-05-25 12:00:00")
    assert one(df.select(timefns.round_to_hour(F.col("t"))))[:3] == [
        datetime(2015, 5, 25, 8), datetime(2015, 5, 25, 9), datetime(2015, 5, 26, 0)]
    assert one(df.select(timefns.round_to_day(F.col("t"))))[3:] == [
        datetime(2015, 5, 25), datetime(2015, 5, 26)]


def test_time_columns_ignore_the_session_zone(spark):
    df = ts(spark, "2015-03-08 02:15:00", "2015-11-01 01:40:00")   # daylight-saving switches
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        assert one(df.select(timefns.round_to_hour(F.col("t")))) == [
            datetime(2015, 3, 8, 2), datetime(2015, 11, 1, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dow_counts_from_sunday(spark):
    df = ts(spark, "2024-01-07 10:00:00", "2024-01-08 10:00:00", "2024-01-13 10:00:00")
    assert one(df.select(timefns.pg_dow(F.col("t")))) == [0, 1, 6]
    assert one(df.select(timefns.weekday_label(F.col("t")))) == ["Weekends", "Weekdays", "Weekends"]


def test_day_blocks(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 10, 14, 18, 22, 23)], "h int")
    assert one(df.select(timefns.day_block(F.col("h")))) == [
        None, "peak_morn", "midday", "peak_aft", "even", "even", None]
    assert one(df.select(timefns.day_block(F.col("h"), wraps=True)))[::6] == ["overnight", "overnight"]


def test_axis_time(spark):
    assert one(spark.range(1).select(timefns.axis_time(F.lit(17)))) == [datetime(1970, 1, 1, 17)]


def test_birth_year(spark):
    df = spark.createDataFrame([("",), ("NULL",), (None,), ("1980",)], "b string")
    assert one(df.select(cleaning.clean_birth_year(F.col("b")))) == [None, None, None, 1980]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("x",)], "b string").select(cleaning.clean_birth_year(F.col("b"))).collect()


def test_cut_is_left_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 17.9, 18.0, 99.9, 100.0, None)], "v double")
    assert one(df.select(buckets.cut(F.col("v"), buckets.AGE_EDGES))) == [
        None, "[0,18)", "[0,18)", "[18,22)", "[60,100)", None, None]
    assert one(df.select(buckets.cut_ordinal(F.col("v"), buckets.AGE_EDGES))) == [
        None, 1, 1, 2, 10, None, None]


def test_round_half_away(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.5,)], "v double")
    assert one(df.select(buckets.round_half_away(F.col("v")))) == [3.0, -3.0, 1.0]


def test_break_labels_with_data_extremes(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.1, 6.0, 7.256)], "v double")
    got = df.select(buckets.cut_between_extremes(F.col("v"), [1, 2, 6], F.lit(0.5), F.lit(7.256)))
    assert one(got) == [1.0, 1.0, 2.0, 6.0, 7.26]


def test_speed_of_zero_seconds_is_missing(spark):
    df = spark.range(1).select(units.mph(units.miles(F.lit(1609.344)), F.lit(0.0)),
                               units.mph(units.miles(F.lit(1609.344)), F.lit(360.0)))
    assert tuple(df.first()) == (None, 10.0)


def test_humidex_by_hand(spark):
    df = spark.createDataFrame([(30.0, 0.0, 288.15), (-5.0, 10.0, 260.0), (25.0, 0.0, 270.0),
                                (30.0, 0.0, None)],
                               "max_temp double, average_wind_speed double, dewp double")
    got = one(df.select(weather.perceived_temp("a")))
    excess = 6.11 * math.exp(5417.753 * (1 / 273.16 - 1 / 288.15)) - 10
    assert got[0] == pytest.approx(30 + 5 / 9 * excess)
    w = (10 * 3.6) ** 0.16
    assert got[1] == pytest.approx(13.12 + 0.6215 * -5 - 11.37 * w + 0.3965 * -5 * w)
    assert got[2] == 25.0
    assert got[3] is None                       # an unknown condition gives no value
    b = one(df.select(weather.perceived_temp("b")))
    assert b[1] == -5.0                         # the wind chill is overwritten


def test_broken_polylines_are_null(spark):
    bad = ["_p~iF 1", "_p~iF\x7f", "~" * 12 + "?" * 2, POLYLINE + "\n"]
    df = spark.createDataFrame([(p,) for p in [*bad, POLYLINE]], "p string").select(decode_polyline(F.col("p")).alias("v"))
    assert [r.v is None for r in df.collect()] == [True] * 4 + [False]


def test_polyline_sample(spark):
    df = spark.createDataFrame([(POLYLINE,), ("",)], "p string").select(decode_polyline(F.col("p")).alias("v"))
    got = [[(round(v.lat, 5), round(v.lon, 5)) for v in r.v] for r in df.collect()]
    assert got == [[(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], []]


def test_both_date_forms(spark):
    df = spark.createDataFrame([("2017-01-05 07:08:09",), ("1/5/2017 7:08",), ("01/05/2017 07:08:09",), (None,)],
                               "t string")
    assert one(df.select(parse_timestamp(F.col("t")))) == [
        datetime(2017, 1, 5, 7, 8, 9), datetime(2017, 1, 5, 7, 8), datetime(2017, 1, 5, 7, 8, 9), None]
    days = spark.createDataFrame([("2017-01-05",), ("1/5/2017",)], "t string")
    assert one(days.select(parse_date(F.col("t")))) == [date(2017, 1, 5)] * 2
