"""From saved route steps to segments weighted by use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import routes, stats
from ..session import saved


def route_legs(steps: DataFrame) -> DataFrame:
    """Segments of all routes in the stored legs layout.

    The decoded vertices are saved first: finding the next vertex reads them
    more than once, and decoding is the costly part.
    """
    vertices = saved(routes.route_vertices(steps), "vertices")
    return routes.segments(vertices).withColumnsRenamed(
        {"id_start": "start_station_id", "id_end": "end_station_id"})


def heat_map(trips: DataFrame, legs: DataFrame) -> DataFrame:
    """Weighted segments, least used first, so that busy ones are drawn last."""
    return stats.ranked(routes.route_segments(trips, legs), ["count"],
                        ["start_station_id", "end_station_id", "start_lat", "start_lon"], ascending=True)
