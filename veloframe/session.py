"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "veloframe", cpus: str = "*", shuffle_partitions: int = 8,
                  memory: str = "12g", scratch: str | None = None) -> SparkSession:
    """A session for tests and benchmarks.  On a cluster, pass your own.

    ``scratch`` becomes ``spark.checkpoint.dir``; without it the Spark defaults or the warehouse serve.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor and the driver see.

    In this order: the conf ``spark.checkpoint.dir``, the folder given to
    ``sparkContext.setCheckpointDir``, and, only where driver and executors are one
    process (master ``local``), the session's warehouse.  A cluster that names no
    folder gets an error: a folder of one machine would lose rows silently.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = context._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if not named and context.master.split("[")[0] == "local":
        named = spark.conf.get("spark.sql.warehouse.dir")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


_made: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_saved(spark: SparkSession) -> int:
    """Remove what :func:`shared_dir` and :func:`saved` wrote in this process; frames that read it end."""
    removed, jvm = 0, spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        removed += bool(files.delete(path, True))
    return removed


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: later steps read the same values however often they run,
    and a lost executor costs a re-read.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
