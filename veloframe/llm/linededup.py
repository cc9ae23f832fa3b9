"""Removal of repeated passages by overlapping three-line windows.

A text is a row of units: its lines, and the sentences of lines with over ``LONG_LINE`` words
(three equal runs of words where such a line has fewer than three sentences), so that a
passage on one long line has windows of its own.  The units that hold a word, trimmed, form
overlapping windows of three.  Each window is hashed to 128 bits; windows that occur more
than once anywhere in the table are found by one aggregation over the hashes, and the
occurrence with the smallest (doc_id, content hash, position) stays.  Every later occurrence
covers its three units; covered positions are merged into stretches and cut out of the text.
An occurrence that overlaps the one that stays, in the same text, covers only units beyond it.

Only hashes and positions are shuffled to find the windows, pre-aggregated per task, so a
passage that a third of all documents hold is one row per task; the join that marks its
later occurrences is a plain join of two written tables, which adaptive execution splits.

What stays repeated: passages of one or two units between differing neighbours, which no
window of three units holds.

Null texts, and texts with fewer than three units that hold a word, pass unchanged.  Units
without a word are never covered, but go where they lie inside a covered stretch.  What is
left of a line stays one line.  A NULL doc_id orders last.  Rows equal in doc_id and text are
one document: they get one and the same result.  Every input row stays a row; other columns
pass through, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, row_hash, saved

WIDTH = 3
#: Lines with more words than this are cut into sentences.
LONG_LINE = 50
SPACES = " \t\r\x0b\x0c"
WORD_START = re.compile(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
SENTENCE_END = re.compile(r"(?<=[.!?])(?=[\x20\x09])|(?<=[\u3002\uFF01\uFF1F])")


def _key(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", row_hash(F.col("text")).alias("h"))


def parts(line: str) -> list[str]:
    """A line, or the sentences of a long one, or three runs of its words; put together they are the line."""
    # Over LONG_LINE words take over 2 * LONG_LINE code points: most lines are told by their length.
    if len(line) <= 2 * LONG_LINE or len(line.encode().split()) <= LONG_LINE:  # of bytes: ASCII white space only
        return [line]
    own = SENTENCE_END.split(line)
    if sum(bool(x.strip(SPACES)) for x in own) >= WIDTH:
        return own
    words = WORD_START.split(line)
    n = -(-len(words) // 3)
    return ["".join(words[k:k + n]) for k in (0, n, 2 * n)]


def units(text: str) -> list[tuple[int, str]]:
    """The units of a text in order, each with the number of its line."""
    return [(k, part) for k, line in enumerate(text.split("\n")) for part in parts(line)]


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """h1, h2 (hash), no_id, doc_id, h (row), at (window number), first, last (unit)."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                digests, counts, first, last = [], [], [], []
                for text in rows.column(2).to_pylist():
                    held, at = [], []
                    for i, (_, s) in enumerate(units(text)):
                        if s := s.strip(SPACES):
                            held.append(s.encode())
                            at.append(i)
                    n = max(len(held) - width + 1, 0)
                    digests += [xxhash.xxh3_128_digest(b"\n".join(held[k:k + width])) for k in range(n)]
                    counts.append(n)
                    first += at[:n]
                    last += at[width - 1:width - 1 + n]
                h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                doc_id = rows.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), doc_id.is_null(), doc_id,
                     rows.column(1).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(first, pa.int32()),
                     pa.array(last, pa.int32())], names=["h1", "h2", "no_id", "doc_id", "h", "at", "first", "last"])

    rows = _key(docs).where("text is not null").select("doc_id", "h", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"h1 long, h2 long, no_id boolean, doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                           "h long, at int, first int, last int")


def covered(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h and the covered stretches of units [from, to], merged and in order."""
    seen = saved(windows(docs, width), "windows")
    place = F.struct("no_id", "doc_id", "h", "at", "last")
    repeated = saved(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("stays"))
                     .where("n > 1").drop("n"), "repeated")
    same = F.expr("doc_id <=> stays.doc_id and h = stays.h")
    later = (seen.join(repeated, ["h1", "h2"])
             .where(~(same & (F.col("at") == F.col("stays.at"))))
             .select("doc_id", "h", F.when(same, F.greatest("first", F.col("stays.last") + 1))
                     .otherwise(F.col("first")).alias("from"), F.col("last").alias("to")))
    merged = F.aggregate(
        F.array_sort("parts"), F.expr("cast(array() as array<struct<from: int, to: int>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (x["from"] <= F.element_at(done, -1)["to"] + 1),
                               F.concat(F.slice(done, 1, F.size(done) - 1),
                                        F.array(F.struct(F.element_at(done, -1)["from"].alias("from"),
                                                         F.greatest(F.element_at(done, -1)["to"], x["to"]).alias("to")))))
        .otherwise(F.concat(done, F.array(x))))
    return (later.groupBy("doc_id", "h").agg(F.collect_set(F.struct("from", "to")).alias("parts"))
            .select("doc_id", "h", merged.alias("cuts")))


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    """The texts without the stretches of units [from, to, from, to, ...]."""
    def one(text, edges):
        if text is None:
            return None
        left, own, start = {}, units(text), 0
        for end, after in zip([*edges[::2], len(own)], [*(e + 1 for e in edges[1::2]), len(own)]):
            for line, s in own[start:end]:
                left.setdefault(line, []).append(s)
            start = after
        return "\n".join("".join(x) for x in left.values())

    return pd.Series([one(t, c) for t, c in zip(texts, cuts)], dtype="object")


def dedup_lines(docs: DataFrame, width: int = WIDTH, count: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, plus the number of units cut (int, last).

    The number's column is named ``count``; by default ``_lines_cut``, with underscores added
    where ``docs`` has that name.
    """
    edges = F.flatten(F.transform("cuts", lambda x: F.array(x["from"], x["to"])))
    cuts = saved(covered(docs, width), "cuts").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"),
                                                      "cuts", edges.alias("edges"))
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("doc_id"),
                      F.col("text").alias("text"), row_hash(F.col("text")).alias("h"))
    # A merge join at every size: whether the cuts would fit a broadcast depends on the corpus.
    both = own.join(cuts.hint("merge"), F.expr("doc_id <=> _id and h = _h"), "left")
    cut = F.col("cuts").isNotNull()
    # Only texts that lose something are handed to Python.
    text = F.when(cut, without(F.when(cut, F.col("text")), F.col("edges"))).otherwise(F.col("text"))
    n_cut = F.coalesce(F.aggregate("cuts", F.lit(0), lambda n, x: n + x["to"] - x["from"] + 1), F.lit(0))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names],
                       n_cut.alias(count or free_name(names, "_lines_cut")))
