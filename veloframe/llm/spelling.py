"""Spelling variants: words one edit apart, found by a relational frontier over a trie.

**Words.** Runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased.  A run whose checksum
with its doc_id is divisible by ``SLIP`` loses one code point.  Distinct results of at least ``SHORTEST``
code points that occur ``SUPPORT`` times or more are the words.  Each task adds up its texts in a
table of bounded size, so a frequent word is a few rows per task.

**Trie.** All words up to ``LONGEST`` code points stand in two tries, one of the words and one of the reversed
words, kept as one table of edges (level, node, c, child); a node is the hash of its prefix.  The frontier holds
states (word, position, node, edits).  A word starts with no edit at the node of its own first half in
the one trie and of its reversed second half in the other: an edit in one half leaves the
other half whole, so nothing is lost, and the widely branching top of the trie
is never searched.  Level by level the frontier is joined with the edges: a state follows its next character, and
one without an edit also skips a character, replaces it or takes in one of the trie's.
Of equal characters in a row the last one is edited.  Each level is written to the shared folder.  States that
have used up their word with one edit are neighbours where their node is a word; the words themselves are
compared, so a clash of hashes adds nothing.  A node has at most as many
edges as the alphabet has characters, so no join multiplies a hot node.

**Longer words** would need as many levels as they have characters.  They meet by their deletion keys instead:
rolling hashes of the word without one character, one for each place, then the same comparison.

**Forms.** A word's form is its most frequent neighbour (ties: the smallest), if at least ``RATIO`` times as frequent;
its root is where the forms lead, found by doubling the step: counts grow along forms, so there
is no circle.

NULL and empty texts have no words.  A NULL doc_id is written as nothing in the checksum.  Repeated rows count
again.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import saved, text_bytes

SLIP = 199
SHORTEST = 6
SUPPORT = 5
RATIO = 5
#: Words of more code points than this meet by deletion keys.
LONGEST = 32
#: A task hands on its counts at so many words.
HELD = 300_000
#: Longer texts are scanned without a list of all their runs.
STREAMED = 1 << 22
RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % SHORTEST)
PRIME = (1 << 61) - 1


def words(docs: DataFrame) -> DataFrame:
    """word and n of every word of at least ``SHORTEST`` code points and ``SUPPORT`` occurrences."""
    def count(batches):
        held: dict[str, int] = {}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for rows in batches:
            for doc_id, data in zip(rows.column(0).to_pylist(), rows.column(1)):
                if not data.is_valid:
                    continue
                text = data.as_py().lower().decode("utf-8", "replace")
                base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = RUN.findall(text) if len(text) < STREAMED else (m[0] for m in RUN.finditer(text))
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), base)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < SHORTEST:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield batch()
                    held = {}
        yield batch()

    parts = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(count, "word string, n long")
    return saved(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT), "words")


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _sides(vocabulary: DataFrame) -> DataFrame:
    """Each word as it is (side 0) and reversed (side 1), with the size of the half that stays whole."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w"), half.alias("start")),
                   F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"), (size - half).alias("start")))
    return vocabulary.select(F.inline(both), "n").withColumn("size", F.length("w"))


def trie(sides: DataFrame) -> str:
    """Where the edges (level, node, c, child) of both tries are written, by level, from the first level used."""
    at = sides.select("side", "w", F.explode(F.sequence(F.lit(SHORTEST // 2), F.col("size") - 1)).alias("level"))
    edges = at.select("level", _node(F.col("side"), F.expr("left(w, level)")).alias("node"), F.expr("substr(w, level + 1, 1)").alias("c"),
                      _node(F.col("side"), F.expr("left(w, level + 1)")).alias("child")).distinct()
    path = shared_dir(sides.sparkSession, "trie")
    edges.write.partitionBy("level").parquet(path)
    return path


def skipped(states: DataFrame) -> DataFrame:
    """``states`` and those that skip a character of their word."""
    may = F.expr("edits = 0 and pos < length(w) and (pos + 1 = length(w) or substr(w, pos + 1, 1) <> substr(w, pos + 2, 1))")
    own = F.struct("pos", "edits")
    skip = F.struct((F.col("pos") + 1).alias("pos"), F.lit(1).alias("edits"))
    return states.select("side", "w", "node", F.inline(F.when(may, F.array(own, skip)).otherwise(F.array(own))))


def step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level down."""
    met = states.join(edges, "node").where("edits = 0 or c = substr(w, pos + 1, 1)")
    same = F.expr("c = substr(w, pos + 1, 1)")
    follow = F.struct((F.col("pos") + 1).alias("pos"), F.col("edits").alias("edits"))
    replace = F.struct((F.col("pos") + 1).alias("pos"), F.lit(1).alias("edits"))
    insert = F.struct(F.col("pos").alias("pos"), F.lit(1).alias("edits"))
    moves = (F.when(same, F.array(follow)).when(F.col("pos") < F.length("w"), F.array(replace, insert))
             .otherwise(F.array(insert)))
    return met.select("side", "w", F.col("child").alias("node"), F.inline(moves))


def short_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, n of near) of all words up to ``LONGEST`` code points; a pair may come twice."""
    spark = vocabulary.sparkSession
    sides = saved(_sides(vocabulary.where(F.length("word") <= LONGEST)), "trie-words")
    top = sides.agg(F.max("size")).first()[0] or 0
    path = trie(sides) if top else ""
    edges = spark.read.schema("node long, c string, child long, level int").parquet(path) if top else None
    seeds = sides.select("side", "w", _node(F.col("side"), F.expr("left(w, start)")).alias("node"), F.col("start").alias("pos"),
                         F.lit(0).alias("edits"))
    carried, ended = None, []
    for level in range(SHORTEST // 2, top + 1):
        fresh = seeds.where(F.col("pos") == level)
        states = skipped(fresh if carried is None else carried.union(fresh.select(*carried.columns)))
        ended.append(states.where("edits = 1 and pos = length(w)"))
        if level < top:
            carried = saved(step(states, edges.where(F.col("level") == level).drop("level")), "frontier")
    ends = sides.select(_node(F.col("side"), F.col("w")).alias("node"), F.col("w").alias("near"), F.col("n").alias("near_n"))
    if not ended:
        return vocabulary.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    done = ended[0]
    for more in ended[1:]:
        done = done.union(more)
    found = done.select("side", "w", "node").join(ends, "node").where("levenshtein(w, near, 1) = 1")
    return found.select(*[F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(a) for c, a in (("w", "word"), ("near", "near"))],
                        "near_n")


def deletion_keys(word: str) -> list[int]:
    """Rolling hashes of a word and of the word without each of its characters in turn."""
    before = [0]
    for c in word:
        before.append((before[-1] * 1_000_003 + ord(c)) % PRIME)
    keys, after, power = {before[-1]}, 0, 1
    for k in range(len(word) - 1, -1, -1):
        keys.add((before[k] * power + after) % PRIME)
        after = (ord(word[k]) * power + after) % PRIME
        power = power * 1_000_003 % PRIME
    return list(keys)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one character was put in, taken out or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common beginning
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) >= len(b)):] == b[low + (len(b) >= len(a)):]


def long_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, n of near) of words of at least ``LONGEST`` code points; a pair may come twice."""
    long = saved(vocabulary.where(F.length("word") >= LONGEST), "long-words")

    def keys(batches):
        for rows in batches:
            for word, n in zip(rows["word"], rows["n"]):
                own = deletion_keys(word)
                for at in range(0, len(own), 1024):
                    yield pd.DataFrame({"key": own[at:at + 1024]}).assign(word=word, n=n)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b)], dtype=bool)

    keyed = saved(long.mapInPandas(keys, "key long, word string, n long"), "deletion-keys")
    other = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = keyed.join(other, "key").where("word <> near").select("word", "near", "near_n").distinct()
    return pairs.where(near("word", "near"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs one edit apart, both ways, once each."""
    return saved(short_pairs(vocabulary).union(long_pairs(vocabulary)).distinct(), "neighbours")


def roots(links: DataFrame) -> DataFrame:
    """word and root, given the forms (word, form) of words that have one."""
    at = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = saved(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                              F.col("_next").isNotNull().alias("_moved")), "roots")
        at = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            return at


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    vocabulary = words(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = neighbours(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best)
    high = -F.col("best.minus") >= RATIO * F.col("n")
    table = saved(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(high, F.col("best.near")).alias("form"), F.when(high, -F.col("best.minus")).alias("form_n")), "forms")
    found = roots(table.where("form is not null"))
    return table.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
