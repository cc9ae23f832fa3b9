"""Order-based operators that do not rely on one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join


def with_next(df: DataFrame, by: Sequence[str], order: Sequence[str], take: dict[str, str],
              slice_of: Column) -> DataFrame:
    """Add columns of the next row of the same key, in ``order`` (NULLs first).

    Every key is cut into consecutive slices by ``slice_of``: a whole number that never
    decreases along ``order``, NULL where the leading order column is NULL.  Slices are
    worked on alone, so a key with a third of all rows is as many tasks as it has slices.
    The last row of a slice takes the first row of the key's next slice, which one
    aggregate knows for all slices.  The join needs no second shuffle of the rows: it
    has the key of the window.  The slicing never changes the answer.
    """
    rest = [c for c in df.columns if c not in by]
    sliced = df.select(F.struct(*by, F.coalesce(slice_of.cast("long"), F.lit(-(1 << 63))).alias("_slice")).alias("_key"), *rest)
    values = list(dict.fromkeys(take.values()))
    needed = [F.col(f"_key.{c}").alias(c) if c in by else F.col(c) for c in dict.fromkeys([*order, *values])]
    heads = sliced.groupBy("_key").agg(F.min(F.struct(*needed)).alias("_head"))
    later = F.lead("_head").over(Window.partitionBy(*[F.col(f"_key.{k}") for k in by]).orderBy("_key._slice"))
    ahead = heads.select("_key", later.alias("_ahead")).select("_key", F.when(F.col("_ahead").isNotNull(), F.struct(*[F.col("_ahead")[c].alias(c) for c in values])).alias("_ahead"))
    taken = [F.col(f"_key.{c}").alias(c) if c in by else F.col(c) for c in values]
    own = F.lead(F.struct(*taken)).over(Window.partitionBy("_key").orderBy(*needed))
    return (sliced.withColumn("_own", own).join(ahead, "_key")
            .withColumn("_next", F.coalesce("_own", "_ahead"))
            .select(*[F.col(f"_key.{c}").alias(c) if c in by else F.col(c) for c in df.columns],
                    *[F.col("_next")[c].alias(out) for out, c in take.items()]))


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str],
                  take: dict[str, str]) -> DataFrame:
    """Add columns of the previous row.  For keys whose size is bounded by a
    dimension (stations of one day, days of one station)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(out) for out, c in take.items()])


def with_dense_index(df: DataFrame, order: Sequence[str], *buckets: Column,
                     name: str = "id") -> DataFrame:
    """Number rows 1..n in ``order`` without sorting everything in one task.

    One or two ``buckets``, coarse then fine, must together never decrease along
    ``order`` (say day and minute for a start time).  Rows are numbered inside
    their finest bucket and shifted by the sizes of the buckets before it: fine
    ones are summed per coarse one, and only the list of coarse sizes is summed
    in one place.
    """
    coarse, fine = buckets if len(buckets) == 2 else (buckets[0], F.lit(0))
    b = df.withColumn("_b", coarse).withColumn("_f", fine)
    sizes = b.groupBy("_b", "_f").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_b").orderBy("_f").rowsBetween(
        Window.unboundedPreceding, -1))
    before = F.sum("_n").over(Window.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1))
    fine_offsets = sizes.select("_b", "_f", F.coalesce(earlier, F.lit(0)).alias("_off"))
    coarse_offsets = (sizes.groupBy("_b").agg(F.sum("_n").alias("_n"))
                      .select("_b", F.coalesce(before, F.lit(0)).alias("_base")))
    local = F.row_number().over(Window.partitionBy("_b", "_f").orderBy(*order))
    numbered = null_safe_join(b.withColumn("_rn", local), fine_offsets, ["_b", "_f"])
    return null_safe_join(numbered, coarse_offsets, ["_b"]).select(
        (F.col("_base") + F.col("_off") + F.col("_rn")).alias(name), *df.columns)


def rolling_sum(df: DataFrame, order_col: str, value: str, k: int, bucket: Column,
                name: str, block: int = 4096) -> DataFrame:
    """Right-aligned sum over the last ``k`` rows; NULL for the first k - 1 rows.

    Rows are numbered, cut into blocks, and the last k - 1 rows of each block
    are repeated at the head of the next, so each block is one small window.
    """
    block = max(block, k)
    idx = with_dense_index(df, [order_col], bucket, name="_i")
    own = F.floor((F.col("_i") - 1) / F.lit(block)).cast("bigint")
    tail = F.pmod(F.col("_i") - 1, F.lit(block)) >= block - (k - 1)
    rows = (idx.withColumn("_own", own)
            .withColumn("_block", F.explode(
                F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))))
    w = Window.partitionBy("_block").orderBy("_i")
    total = F.sum(value).over(w.rowsBetween(-(k - 1), 0))
    return (rows.withColumn(name, F.when(F.col("_i") >= k, total))
            .where(F.col("_block") == F.col("_own"))
            .select(*df.columns, name))
