"""Text file readers with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

# Fixed pattern: a month-first date, with or without a time behind it.
MONTH_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})"


# A text no field holds: the parser returns it for an unquoted empty field, so
# that a quoted empty one stays apart.
UNQUOTED_EMPTY = "\u0000"


def _iso(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), MONTH_FIRST, "$3-$1-$2")


def parse_timestamp(text: Column) -> Column:
    """NTZ timestamp, ISO or month-first; NULL stays NULL and junk raises."""
    return _iso(text).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    return _iso(text).cast("date")


def _csv(spark: SparkSession, paths, schema: T.StructType, null: str = UNQUOTED_EMPTY,
         names: str | None = None) -> DataFrame:
    """CSV with a header per file, nested folders included, whatever the files are called
    (``names``, a glob, restricts them).  An unquoted empty field is NULL and a quoted one
    is the empty string."""
    reader = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
              .option("nullValue", null).option("emptyValue", "").option("mode", "FAILFAST"))
    return (reader.option("pathGlobFilter", names) if names else reader).csv(paths)


def read_trips(spark: SparkSession, paths, names: str | None = None) -> DataFrame:
    """Raw trips of one or many files, each with its own header."""
    raw = _csv(spark, paths, schemas.TRIPS_FILE, names=names)
    return (raw.withColumn("start_time", parse_timestamp(F.col("start_time")))
            .withColumn("stop_time", parse_timestamp(F.col("stop_time"))))


def read_stations(spark: SparkSession, path, names: str | None = None) -> DataFrame:
    raw = _csv(spark, path, schemas.STATIONS_FILE, names=names)
    return raw.withColumn("online_date", parse_date(F.col("online_date")))


def read_weather(spark: SparkSession, path, names: str | None = None) -> DataFrame:
    raw = _csv(spark, path, schemas.WEATHER_FILE, names=names)
    return raw.withColumn("date", parse_date(F.col("date")))


def read_legs(spark: SparkSession, path, names: str | None = None) -> DataFrame:
    """Route legs; ``NA`` marks a missing value."""
    return _csv(spark, path, schemas.LEGS_FILE, null="NA", names=names)


def _whole_lines(spark: SparkSession, path) -> bool:
    """Whether the first line that is not blank is a JSON value of its own."""
    first = spark.read.option("recursiveFileLookup", True).text(path).where("trim(value) <> ''").first()
    try:
        json.loads(first[0]) if first else None
    except ValueError:
        return False
    return True


def read_boundaries(spark: SparkSession, path, id_key: str = "gid",
                    name_key: str = "community", lines: bool | None = None) -> DataFrame:
    """Polygon vertices (gid, name, ring, pos, x, y) of GeoJSON.

    Each record is a feature or a FeatureCollection.  ``lines`` says that every line is a
    record, which large files need to be split; by default the first line tells.  Rings of
    all parts are numbered through, and parity over all of them makes holes work.  Broken
    records, and geometries other than Polygon and MultiPolygon, raise.
    """
    lines = _whole_lines(spark, path) if lines is None else lines
    records = (spark.read.schema(schemas.BOUNDARY_RECORD).option("mode", "FAILFAST").option("multiLine", not lines)
               .option("recursiveFileLookup", True).json(path))
    feature = records.select(F.explode(F.coalesce("features", F.array(F.struct("properties", "geometry")))).alias("f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    strict = {"mode": "FAILFAST"}
    rings = F.when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>", strict)).when(
        kind == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>", strict))).otherwise(
        F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no geometry"))))
        .cast("array<array<array<double>>>"))
    return (feature.select(F.col("f.properties")[id_key].cast("int").alias("gid"),
                           F.col("f.properties")[name_key].alias("name"),
                           F.posexplode(rings).alias("ring", "_ring"))
            .select("gid", "name", "ring", F.posexplode("_ring").alias("pos", "_p"))
            .select("gid", "name", "ring", "pos", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y")))


def sql_source(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Run a query over the given frames; no row cap."""
    return spark.sql(text, **views) if views else spark.sql(text)
