"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_summary(df: DataFrame, path: str, partition_cols: Sequence[str] = (),
                 sort_cols: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Materialise a summary as Parquet.

    With partition columns the rows are rebalanced on them first: adaptive
    execution joins small partitions and splits large ones, so a busy day
    becomes several files of even size.  Sorting is per task; it narrows
    row-group statistics without a global sort.
    """
    out = df.hint("rebalance", *partition_cols) if partition_cols else df
    if sort_cols:
        out = out.sortWithinPartitions(*partition_cols, *sort_cols)
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def staging_overwrite(df: DataFrame, path: str) -> None:
    """Replace the staging data, schema kept."""
    df.write.mode("overwrite").parquet(path)


def empty_staging(spark: SparkSession, path: str) -> None:
    """Remove all staging rows; the schema stays readable."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def scan_summary(spark: SparkSession, path: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    (df.write.mode("overwrite").option("header", True).option("nullValue", null)
     .option("emptyValue", '""').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
