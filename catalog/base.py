"""Registry of named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, fn: Query, sql: str | None = None, ctes: Sequence[str] = (),
             floats: Sequence[str] = ()) -> None:
    """Add a query.  ``floats`` are rounded on both sides, since the order of a
    floating-point sum differs between engines."""
    assert name not in QUERIES, name

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(spark, sf_dir)
        return out.withColumns({c: F.round(c, DIGITS) for c in floats}) if floats else out

    QUERIES[name] = run
    if sql is None:
        return
    if floats:
        rounded = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in floats)
        sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
    ORACLE[name] = with_ctes(sql, *ctes)
