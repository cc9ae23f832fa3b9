"""Bucketing columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket edges and labels of the speed tables.
AGE_EDGES = (0, 18, 22, 25, 30, 35, 40, 45, 50, 60, 100)
DISTANCE_EDGES = (0, 1, 1.5, 2.5, 15)
DISTANCE_LABELS = ("< 1 miles", "1 to 1.5 miles", "1.5 to 2.5 miles", "≥2.5 miles")
EXPECTED_EDGES = (0, 300, 600, 900, 1200, 5000)
EXPECTED_LABELS = ("Exp <5 minutes", "Exp 5-10 minutes", "Exp 10-15 minutes",
                   "Exp 15-20 minutes", "Exp ≥ 25 minutes")
# Weather bucket edges.
PRECIP_EDGES = (0, 0.001, 0.01, 0.1, 0.2, 0.4, 1, 10)
HUMIDITY_EDGES = (36.584, 50, 54.2, 66.7, 75, 83.3, 100)


def interval_labels(edges: Sequence[float]) -> list[str]:
    """Edges with three significant digits, or as many more as tell them apart."""
    for digits in range(3, 13):
        shown = [f"{e:.{digits}g}" for e in edges]
        if len(set(shown)) == len(shown):
            break
    return [f"[{lo},{hi})" for lo, hi in zip(shown, shown[1:])]


def cut(value: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Left-closed, right-open buckets; anything outside the edges is NULL."""
    labels = labels or interval_labels(edges)
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = (value >= F.lit(float(lo))) & (value < F.lit(float(hi)))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def cut_ordinal(value: Column, edges: Sequence[float]) -> Column:
    """The 1-based position of the bucket ``cut`` names, for ordering labels."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:]), start=1):
        inside = (value >= F.lit(float(lo))) & (value < F.lit(float(hi)))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def floor_bucket(value: Column, width: float) -> Column:
    """Lower edge of the equal-width bucket a value falls in."""
    return F.floor(value / F.lit(float(width))).cast("double") * F.lit(float(width))


def round_half_away(value: Column, digits: int = 0) -> Column:
    return F.round(value, digits)


def cut_between_extremes(value: Column, breaks: Sequence[float],
                         lo: Column, hi: Column) -> Column:
    """Right-closed buckets whose outer edges are the data's own extremes.

    A bucket is labelled by its upper edge rounded to two digits.  Edges are
    sorted before use while labels keep the given order, so breaks outside the
    data's range still yield a label for every value.
    """
    given = [lo, *[F.lit(float(b)) for b in breaks], hi]
    ordered = F.sort_array(F.array(*given))
    labels = [F.round(edge, 2) for edge in given[1:]]
    out = F.when(value <= ordered[1], labels[0])
    for i in range(1, len(labels)):
        out = out.when(value <= ordered[i + 1], labels[i])
    return out
