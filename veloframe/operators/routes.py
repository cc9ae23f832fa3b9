"""Saved routes: vertices, segments, and segments weighted by use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import route_key
from ..functions.polyline import decode_polyline
from .flows import pair_counts
from .sequence import with_next

#: Step numbers of a route that are worked on together.
STRETCH = 1 << 16


def route_vertices(steps: DataFrame, polyline: str = "polyline", metres: str = "distance_m",
                   seconds: str = "duration_s") -> DataFrame:
    """One row per vertex; the step's length and minutes repeat on each.

    ``steps`` has one row per route step: id_start, id_end, step_no, polyline,
    length and duration.
    """
    keep = [c for c in steps.columns if c not in (polyline, metres, seconds)]
    return (steps.select(*keep, F.col(metres).alias("m"),
                         (F.col(seconds) / F.lit(60.0)).alias("minutes"),
                         F.posexplode(decode_polyline(F.col(polyline))).alias("vertex_no", "_v"))
            .select(*keep, "vertex_no", F.col("_v.lat").alias("lat"), F.col("_v.lon").alias("lon"),
                    "m", "minutes"))


def segments(vertices: DataFrame, order: Sequence[str] = ("step_no", "vertex_no"),
             slice_of: Column | None = None) -> DataFrame:
    """Each vertex with the next one of its route; the last one has none.

    A route is worked on in stretches of ``STRETCH`` step numbers; ``slice_of`` names other slices (see
    ``with_next``).  Shorter ones cost a row each in the table of first rows, which is shuffled three times.
    """
    return with_next(vertices, by=["id_start", "id_end"], order=list(order),
                     take={"end_lat": "lat", "end_lon": "lon"},
                     slice_of=F.floor(F.col(order[0]) / STRETCH) if slice_of is None else slice_of).select(
        "id_start", "id_end", F.col("lat").alias("start_lat"), "end_lat",
        F.col("lon").alias("start_lon"), "end_lon", "m", "minutes")


def route_segments(trips: DataFrame, legs: DataFrame) -> DataFrame:
    """Every segment of every used route with the route's trips and days.

    Trips are reduced to one row per pair first.  Legs are the large side and a
    popular pair may hold many of them; the pair side is unique per key, so
    adaptive skew handling may split such a pair freely.
    """
    used = pair_counts(trips)
    return (legs.join(used, ["start_station_id", "end_station_id"])
            .select("start_lon", "end_lon", "start_lat", "end_lat", "count",
                    F.col("m").alias("distance"), "num_days", "start_station_id",
                    "end_station_id", "minutes",
                    route_key(F.col("start_station_id"), F.col("end_station_id")).alias("grp")))
