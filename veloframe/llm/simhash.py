"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes.  Two that differ in at most 3 bits share at least 5 bytes at
their positions.  The index holds each fingerprint under groups of byte positions chosen
so that any 5 of the 8 positions contain a whole group (all triples of each half: by the
pigeonhole principle 5 positions put 3 into one half).  Within an index entry the shared
positional bytes of each pair are tallied, pairs below 5 are dropped and the rest verified
by their differing bits.

Only distinct fingerprints enter, so a text that a third of all rows repeat is one entry.
An entry hands on a spanning forest of its links, never its pairs, and an entry with
more than ``block`` fingerprints is dealt as pairs of blocks over many tasks.  No link is
lost: every pair within the distance meets in at least one entry and one pair of blocks.

Null or empty texts have fingerprint zero and link like any other.  Repeated rows stay
rows of the result.  A row without doc_id gets the smallest doc_id of its group, or NULL
where the group has none.  Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, row_hash, saved, text_bytes

SEED = 42
BITS = 3
MIN_BYTES = 8 - BITS
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
BLOCK = 2048
PIECE = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, highest first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at:at + PIECE].astype(">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            sums = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8)
            total += sums.sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits as an unsigned number; repeated shingles count as often as they occur."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - width].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())], np.uint64)
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (long) of every row."""
    def make():
        return lambda doc_id, text: [(doc_id, _signed(fingerprint(text, width)))]

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), make, "doc_id long, fp long")


def spanning_links(values: Sequence[int]) -> list[tuple[int, int]]:
    """A forest that connects what links of BITS bits connect among these fingerprints."""
    values = np.unique(np.asarray(values, np.int64).view(np.uint64))
    n = len(values)
    label = np.arange(n)
    pairs = []
    for at in range(0, n, 256):
        xor = values[at:at + 256, None] ^ values[None, at:]
        tally = (xor.view(np.uint8).reshape(*xor.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(tally >= MIN_BYTES)  # count filter
        near = np.bitwise_count(xor[i, j]) <= BITS  # verify
        i, j = i[near] + at, j[near] + at
        pairs.append(np.stack([i[i < j], j[i < j]]))
    i, j = np.concatenate(pairs, axis=1)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    signed = values.view(np.int64)
    return [(int(signed[k]), int(signed[label[k]])) for k in np.nonzero(label != np.arange(n))[0]]


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all their links do."""
    def byte(k):
        return F.shiftrightunsigned("fp", 8 * (7 - k)).bitwiseAND(255)

    keys = F.array(*[F.lit(n).cast("long") * (1 << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c)
                     for n, (a, b, c) in enumerate(TRIPLES)])
    entries = saved(classes.select("fp", F.explode(keys).alias("key")), "postings")
    sizes = saved(entries.groupBy("key").count().where("count > 1"), "sizes")
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (entries.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    groups = dealt.groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return map_rows(groups.select("fps"), lambda: spanning_links, "a long, b long")


def _groups(signed: DataFrame, block: int) -> DataFrame:
    """fp, root (one number per group) and component_id of every distinct fingerprint of ``signed``."""
    classes = saved(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = components(links(classes, block)).withColumnRenamed("node", "fp")
    member = saved(classes.join(linked, "fp"), "members")
    groups = saved(member.groupBy("root").agg(F.min("first_id").alias("group_id")), "groups")
    of_group = saved(member.join(groups, "root").select("fp", "root", "group_id"), "of-group")
    return saved(classes.join(of_group, "fp", "left")
                 .select("fp", F.coalesce("root", "fp").alias("root"),
                         F.coalesce("group_id", "first_id").alias("component_id")), "ids")


def simhash_groups(docs: DataFrame, width: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    signed = saved(fingerprints(docs, width), "fingerprints")
    return signed.join(_groups(signed, block), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each group: the smallest by doc_id (NULL last), then by
    the hash of its text.

    Groups are of texts, so different texts that share a doc_id are judged apart.  Of rows
    equal in doc_id and text one stays.  Columns pass through, whatever their names.
    """
    own, other = row_hash("doc_id", "text"), row_hash(F.col("text"))

    def make():
        return lambda doc_id, a, b, text: [(doc_id, a, b, _signed(fingerprint(text, width)))]

    signed = saved(map_rows(docs.select("doc_id", own.alias("a"), other.alias("b"), text_bytes().alias("text")), make,
                            "doc_id long, a long, b long, fp long"), "fingerprints")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "b", "a")).alias("s")
    stays = saved(signed.join(_groups(signed, block), "fp").groupBy("root").agg(smallest).select("s.a", "s.b"), "stays")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), own.alias("a"), other.alias("b"))
    return (rows.join(stays, ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
            .select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))
