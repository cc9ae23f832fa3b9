"""Cleaning columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_birth_year(raw: Column) -> Column:
    """Text year to int; ``''`` and ``'NULL'`` mean missing, other junk raises."""
    return F.nullif(F.nullif(raw, F.lit("")), F.lit("NULL")).cast("int")


def age_at(start_time: Column, birth_year: Column) -> Column:
    return F.year(start_time) - birth_year


def route_key(start: Column, end: Column) -> Column:
    return F.concat_ws(".", start.cast("string"), end.cast("string"))


def coord_text(lat: Column, lon: Column) -> Column:
    return F.concat_ws(", ", lat.cast("string"), lon.cast("string"))


def make_point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))
