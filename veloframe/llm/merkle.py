"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf: the SHA-256 of its fields.  The leaves of a source, ascending by doc_id,
form a tree of runs of ``FAN`` nodes; the roots of the sources, ascending by source, form
one more tree of the same shape.  Digests travel and are hashed as lowercase hex text.

A *superblock* is a subtree of ``FAN ** HEIGHT`` leaves in a row of one source.  On the way up a
superblock is one group that hands on one digest; these digests are the leaves of the next round,
until a source is one node.  On the way down each superblock is cogrouped with the one row of
outer nodes that its leaves need: the siblings on the path from its top to the root.
In that task the local reduction is finished, proofs are joined and leaves are folded to the
root.  No group is larger than a superblock, however many rows a source has, and texts are
hashed where they lie: only digests are shuffled.

The place of a leaf in its source comes from one range sort of all digests and the counts per
(partition, source): no window over a source.  Rows of equal doc_id are ordered by leaf, and
rows that are equal in all fields are interchangeable.

A NULL field is ``-``, so it differs from an empty one.  NULL doc_ids come first in their source and
are never tampered with; the NULL source comes first of the sources.  Repeated rows are
leaves of their own.  Columns beside the five fields are ignored, whatever their names.  Texts of any length
are read whole.  An empty table has no rows in any result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import saved

FAN = 16
HEIGHT = 3
BLOCK = FAN ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One leaf in so many is tampered with, by the checksum of its doc_id.
EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(**replaced: Column) -> Column:
    """The digest of a row; ``replaced`` gives other values for some fields."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered() -> Column:
    """Whether the checksum of the doc_id picks the row; never for NULL."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """row (a number of its own), source, doc_id, leaf and, if tampered with, the leaf it would then be."""
    lowered = leaf(text=F.translate(F.col("text").cast("string"), UPPER, LOWER))
    return saved(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("source").cast("string").alias("source"), "doc_id",
        leaf().alias("leaf"), F.when(tampered(), lowered).alias("changed")), "leaves")


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` sorted over all partitions, with _part and _pos (its place in there)."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return saved(ordered.withColumn("_at", at), "ordered").withColumns(
        {"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (number of the source), idx (place in it) and n (leaves of it), and the table of sources.

    What is joined has a row per (partition, source).
    """
    placed = _placed(rows, "source", "doc_id", "leaf", "row")
    parts = placed.groupBy("_part", "source").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    by_part = Window.partitionBy("source").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = saved(parts.withColumn("_before", before), "leaf-counts")
    named = _placed(parts.groupBy("source").agg(F.sum("_n").alias("n")), "source")
    sizes = named.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    sources = saved(named.join(shift, "_part").select(
        (F.col("_shift") + F.col("_pos")).alias("tree"), "source", "n"), "sources")
    own = parts.select(F.col("_part").alias("_p"), F.col("source").alias("_s"), "_first", "_before").join(
        sources.withColumnRenamed("source", "_t"), F.expr("_s <=> _t")).drop("_t")
    out = placed.join(own, (F.col("_part") == F.col("_p")) & F.expr("source <=> _s")).select(
        "tree", (F.col("_before") + F.col("_pos") - F.col("_first")).alias("idx"), "n", "doc_id", "leaf", "changed")
    return saved(out, "numbered-leaves"), sources


def _levels(n: int) -> int:
    """Levels between ``n`` nodes and their root."""
    k = 0
    while FAN ** k < n:
        k += 1
    return k


def local_levels(digests: list[str], n: int) -> list[list[str]]:
    """Nodes of a superblock by level, its leaves first, as far as a tree of ``n`` leaves goes."""
    out = [digests]
    for _ in range(min(HEIGHT, _levels(n))):
        below = out[-1]
        out.append([_sha("".join(below[k:k + FAN])) for k in range(0, len(below), FAN)])
    return out


def local_path(levels: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """Siblings of leaf ``k`` before and after its path, level by level."""
    before, after = [], []
    for nodes in levels[:-1]:
        start = k - k % FAN
        before.append("".join(nodes[start:k]))
        after.append("".join(nodes[k + 1:start + FAN]))
        k //= FAN
    return before, after


def fold(digest: str, before, after) -> str:
    """From a node along its siblings to the top."""
    for a, b in zip(before, after):
        digest = _sha(a + digest + b)
    return digest


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("long"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of nodes (tree, idx, n, digest): what is given, its superblocks, theirs, up to one node a tree."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        top = local_levels(pdf["digest"].tolist(), n)[-1]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "idx": pdf["block"].iloc[:1], "n": [-(-n // BLOCK)], "digest": top})

    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        rounds.append(saved(_blocks(rounds[-1]).groupBy("tree", "block").applyInPandas(
            reduce, "tree long, idx long, n long, digest string"), "superblocks"))
        most = -(-most // BLOCK)
    return rounds


OUTER = "tree long, idx long, n long, digest string, before array<string>, after array<string>, subroot string, root string"


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Outer nodes of every node of the first of ``rounds``, given those of the last (``OUTER`` without n and digest)."""
    def join(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, over = nodes.sort_values("idx"), outer.iloc[0]
        levels = local_levels(nodes["digest"].tolist(), int(nodes["n"].iloc[0]))
        paths = [local_path(levels, k) for k in range(len(nodes))]
        return nodes.assign(before=[p[0] + list(over["before"]) for p in paths],
                            after=[p[1] + list(over["after"]) for p in paths],
                            subroot=over["subroot"], root=over["root"])[[c.split()[0] for c in OUTER.split(", ")]]

    outer = top
    for nodes in reversed(rounds[:-1]):
        outer = saved(_blocks(nodes).groupBy("tree", "block").cogroup(
            outer.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInPandas(join, OUTER), "outer-nodes")
    return outer


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, outer nodes by superblock, sources): the manifest of ``docs``.

    Sources come as tree, source, n, subroot and root.
    """
    rows, sources = numbered(leaves(docs))
    first = rows.select("tree", "idx", "n", F.col("leaf").alias("digest"))
    rounds = climb(first)
    if len(rounds) == 1:  # every source is a lone leaf; its superblock holds just that
        rounds.append(first)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    n_trees = sources.count()
    upper = climb(rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                    F.lit(n_trees).cast("long").alias("n"), "digest"))
    none = F.expr("cast(array() as array<string>)")
    crown = upper[-1].select("tree", "idx", none.alias("before"), none.alias("after"), F.lit("").alias("subroot"),
                             F.col("digest").alias("root"))
    over = descend(upper, crown).select(F.col("idx").alias("_tree"), "before", "after", "root")
    top = saved(subroots.join(over, F.col("tree") == F.col("_tree")).select(
        "tree", F.lit(0).cast("long").alias("idx"), "before", "after", "subroot", "root"), "subroots")
    outer = descend(rounds[1:], top)
    return rows, outer.select("tree", "idx", "before", "after", "subroot", "root"), sources.join(
        top.select("tree", "subroot", "root"), "tree")


def prove(rows: DataFrame, outer: DataFrame) -> DataFrame:
    """Per leaf its proof and the root that it, or what it was changed into, folds to."""
    out = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")

    def finish(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        own, over = own.sort_values("idx"), outer.iloc[0]
        levels = local_levels(own["leaf"].tolist(), int(own["n"].iloc[0]))
        above, below = list(over["before"]), list(over["after"])
        rest = "".join(a + b for a, b in zip(above, below))
        proofs, folded = [], []
        for k, (kept, changed) in enumerate(zip(own["leaf"], own["changed"])):
            before, after = local_path(levels, k)
            proofs.append(_sha("".join(a + b for a, b in zip(before, after)) + rest))
            folded.append(fold(fold(kept if changed is None else changed, before, after), above, below))
        return pd.DataFrame({"doc_id": own["doc_id"].astype("Int64"), "leaf": own["leaf"], "subroot": over["subroot"], "root": over["root"],
                             "proof_sha256": proofs, "folded_root": folded, "verified": [f == over["root"] for f in folded]})

    return _blocks(rows).groupBy("tree", "block").cogroup(
        outer.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInPandas(finish, out)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``."""
    rows, outer, _ = build(docs.select(*FIELDS))
    return prove(rows, outer)


def oracle(levels: int = 6) -> str:
    """The manifest in DuckDB SQL, for at most ``FAN ** levels`` leaves a source and as many sources."""
    def h(x):
        return f"sha256({x})"

    def field(x):
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def digest(text):
        return h(" || ".join(field(x) for x in (*FIELDS[:-1], text)))

    crc = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)")
    steps = [f"""l AS (SELECT *, row_number() OVER () AS r, {digest('text')} AS leaf,
  CASE WHEN {crc} % {EVERY} = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)""",
             "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
             """n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
  leaf AS digest, count(*) OVER (PARTITION BY tree) AS n, r FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source)"""]

    def tree(a, b):
        """Levels of the tables ``a``0 (nodes) with the path strings of each node in ``b``."""
        for k in range(levels):
            steps.append(f"""{b}{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS pre,
  CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS post
  FROM {a}{k} WINDOW w AS (PARTITION BY tree, idx // {FAN} ORDER BY idx))""")
            steps.append(f"""{a}{k + 1} AS (SELECT tree, idx // {FAN} AS idx, CASE WHEN any_value(n) > 1 THEN {h("string_agg(digest, '' ORDER BY idx)")} ELSE any_value(digest) END AS digest,
  (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {a}{k} GROUP BY tree, idx // {FAN})""")

    tree("n", "p")
    steps.append(f"m0 AS (SELECT 0 AS tree, tree AS idx, digest, count(*) OVER () AS n FROM n{levels})")
    tree("m", "q")
    proof, folded, joins = [], "coalesce(l.changed, l.leaf)", []
    for a, place, own in (("p", "n0.tree = {t}.tree AND n0.idx // {w} = {t}.idx", "n0"), ("q", "n0.tree // {w} = {t}.idx", "s")):
        for k in range(levels):
            t = f"{a}{k}"
            joins.append(f"JOIN {t} ON {place.format(t=t, w=FAN ** k)}")
            proof.append(f"coalesce({t}.pre || {t}.post, '')")
    steps.append(f"""f0 AS (SELECT l.doc_id, l.leaf, n{levels}.digest AS subroot, m{levels}.digest AS root, {h(" || ".join(proof))} AS proof_sha256, {folded} AS f0,
  {", ".join(f"{t}.pre AS {t}a, {t}.post AS {t}b" for t in [f"{a}{k}" for a in "pq" for k in range(levels)])}
  FROM l JOIN n0 ON l.r = n0.r JOIN n{levels} ON n0.tree = n{levels}.tree CROSS JOIN m{levels} {" ".join(joins)})""")
    for i, t in enumerate([f"{a}{k}" for a in "pq" for k in range(levels)]):
        steps.append(f"f{i + 1} AS (SELECT * EXCLUDE (f{i}), CASE WHEN {t}a IS NULL THEN f{i} ELSE {h(f'{t}a || f{i} || {t}b')} END AS f{i + 1} FROM f{i})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, f{2 * levels} AS folded_root, f{2 * levels} = root AS verified FROM f{2 * levels}"""
