"""Declared schemas of the input files."""

from pyspark.sql import types as T

# Timestamps and dates of the trip and station files are read as text first:
# both ISO and month-first forms occur, and the readers accept either.
TRIPS_FILE = T.StructType([
    T.StructField("trip_id", T.LongType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("stop_time", T.StringType()),
    T.StructField("bike_id", T.DoubleType()),
    T.StructField("trip_duration", T.DoubleType()),
    T.StructField("start_station_id", T.IntegerType()),
    T.StructField("start_station_name", T.StringType()),
    T.StructField("end_station_id", T.IntegerType()),
    T.StructField("end_station_name", T.StringType()),
    T.StructField("user_type", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("birth_year", T.StringType()),
])

STATIONS_FILE = T.StructType([
    T.StructField("station_id", T.IntegerType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("dpcapacity", T.IntegerType()),
    T.StructField("online_date", T.StringType()),
    T.StructField("blank", T.StringType()),
])

WEATHER_MEASURES = ["average_temp", "visibility", "average_wind_speed", "max_temp",
                    "min_temp", "precip", "dewp", "snow_depth_mm"]
WEATHER_FLAGS = ["fog", "rain_drizzle", "snow_ice", "hail", "thunder", "tornado_funnel"]

WEATHER_FILE = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_MEASURES]
    + [T.StructField(c, T.BooleanType()) for c in WEATHER_FLAGS]
    + [T.StructField("relative_humidity", T.DoubleType())]
)

LEGS_FILE = T.StructType([
    T.StructField("start_station_id", T.IntegerType()),
    T.StructField("end_station_id", T.IntegerType()),
    T.StructField("start_lat", T.DoubleType()),
    T.StructField("end_lat", T.DoubleType()),
    T.StructField("start_lon", T.DoubleType()),
    T.StructField("end_lon", T.DoubleType()),
    T.StructField("m", T.DoubleType()),
    T.StructField("minutes", T.DoubleType()),
])

# One GeoJSON feature per JSON record; Polygon and MultiPolygon differ in depth,
# so coordinates stay text until the geometry type is known.
BOUNDARY_FEATURE = T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])

# A record is one feature, or a collection of them.
BOUNDARY_RECORD = T.StructType([*BOUNDARY_FEATURE.fields,
                                T.StructField("features", T.ArrayType(BOUNDARY_FEATURE))])
