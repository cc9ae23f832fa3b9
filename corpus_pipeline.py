"""The corpus pipeline: quality, repeated lines, near-duplicates, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet
to the shared folder and read back as the next stage's ``docs``.  All but the last return
the columns of ``documents``.  What stays after a stage is what the next one works on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloframe.llm.common import free_name
from veloframe.llm.linededup import dedup_lines
from veloframe.llm.mixing import sample
from veloframe.llm.packing import pack_documents
from veloframe.llm.quality import keep_good
from veloframe.llm.simhash import drop_near_duplicates
from veloframe.session import saved

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a document that loses its last word with them goes."""
    count = free_name(docs.columns, "_lines_cut")
    cut = dedup_lines(docs, count=count)
    left = cut.where((F.col(count) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(count)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities."""
    return sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing),
          ("packing", packing)]

#: The language model, the Hamming links and the genetic packing have no SQL form; tests/llm
#: holds each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
