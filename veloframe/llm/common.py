"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import saved

__all__ = ["table", "map_rows", "text_bytes", "saved", "components", "row_hash", "free_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; NULL stays NULL."""
    return F.col(column).cast("string").cast("binary")


def row_hash(*columns: str | Column) -> Column:
    """64 bits that identify a row by content; NULL and empty differ."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Rows to rows in Arrow batches of a bounded size in bytes.

    ``make()`` runs once per task and returns ``f(*values) -> iterable of tuples``,
    called once per input row.  Output is handed on every few thousand rows, so
    memory does not follow the partition.
    """
    names = df.columns
    out_schema = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        f = make()

        def batch_of(rows):
            columns = zip(*rows) if rows else [[] for _ in out_schema]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t.type) for c, t in zip(columns, out_schema)], schema=out_schema)

        rows = []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for values in zip(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names]):
                    rows.extend(f(*values))
                if len(rows) >= 2048:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root) for every node that has an edge.

    ``edges`` has long columns a and b.  Alternates large-star and small-star steps:
    every larger neighbour of a node moves to the node's smallest neighbour, until the
    edges are stars, a number of rounds that grows with the logarithm of the longest
    chain.  Each step is written to the shared folder, so the lineage stays short, and
    a star centre of any degree is a join side that adaptive execution splits.
    """
    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "p").cast("decimal(20,0)"))).first())

    e = saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p"))
              .where("v <> p").distinct(), "links")
    seen = state(e)
    for _ in range(max_rounds):
        both = e.select("v", "p").union(e.select("p", "v")).toDF("v", "p")
        low = saved(both.groupBy("v").agg(F.min("p").alias("m"))
                    .select("v", F.least("v", "m").alias("m")), "low")
        large = saved(both.where("p > v").join(low, "v").select(F.col("p").alias("v"), F.col("m").alias("p"))
                      .distinct(), "large")
        low = saved(large.groupBy("v").agg(F.min("p").alias("m")), "low")
        small = large.join(low, "v").where("p > m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        e = saved(small.union(low).distinct(), "links")
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("p").alias("root")).union(
        e.select(F.col("p"), F.col("p")).distinct())
