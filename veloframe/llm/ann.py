"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers.

**Graph.** Equal vectors are one node, so a vector that a third of all rows share is one
node, too.  The first neighbours come from blocks of nodes on the same side of random planes
through the mean; a block over twice ``LEAF`` is halved at the median along a further random
direction until none is left.
Each round then joins neighbours of neighbours: every node gathers its neighbours and a
bounded number of those that name it, compares those that have not met there yet with the
others, and hands each one what is closer than its farthest neighbour so far.  Nodes keep
their ``K`` best.  Rounds go on until fewer than ``DELTA`` of the edges are new.  Every
gathering has a bounded size, and so has every block.

**Search.** A query starts at its own node.  Its beam holds the nearest nodes met, ``BEAM`` up
to ``BEAM_ROWS`` nodes and more with the fourth root of their number; each round opens all of
the beam that are not open yet, until none is left.  The beam only ever gets nearer, so this
ends.  All queries go on together, as joins of (query, node) with the graph.

The nearest nodes are spread to the vec_ids of their rows (the ``top`` + 1 smallest of each
node are all that a result can need) and ranked by the exact Euclidean distance in double
precision of the original vectors, ties to the smaller vec_id.

Vectors that are NULL, zero, or hold NULL or non-finite components take no part, neither do
rows without vec_id.  A row repeated in full counts once.  Vectors of different lengths are
never compared.  With fewer rows than asked for, all are returned; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K = 24
BACK = 16
DELTA = 0.002
TREES = 16
LEAF = 1024
BEAM = 112
BEAM_ROWS = 50_000
SEED = 7


def nodes_of(embeddings: DataFrame, top: int) -> DataFrame:
    """node, v (array of doubles), f (32-bit floats as bytes) and ids (the ``top`` + 1 smallest
    vec_ids) of each distinct vector."""
    fine = (F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & fine)
            .withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("_n", first).where(F.col("_n") <= top + 1).select("v", "vec_id").distinct()
    made = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    names = "v array<double>, ids array<bigint>, f binary"

    def pack(batches):
        for batch in batches:
            f = [np.asarray(v, np.float32).tobytes() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f, pa.binary())], names=["v", "ids", "f"])

    packed = made.select("v", "ids").mapInArrow(pack, names)
    return saved(packed.select(F.monotonically_increasing_id().alias("node"), "v", "ids", "f"), "nodes")


def _floats(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1)


def _top(rows: DataFrame, by: str, k: int, order: tuple[str, ...]) -> DataFrame:
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_r") <= k).drop("_r")


def _edges(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, k: int,
           new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id the up to k closest others that beat its worst neighbour; pairs without a new one have met."""
    n = len(ids)
    norm = (x * x).sum(1)
    d = np.maximum(norm[:, None] + norm[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    d[np.ix_(~new, ~new)] = np.inf
    k = min(k, n - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
    dist = np.take_along_axis(d, near, 1)
    r, c = np.nonzero((dist < worst[:, None]) & np.isfinite(dist))
    return ids[r], ids[near[r, c]], dist[r, c]


def _group_edges(groups: DataFrame, k: int) -> DataFrame:
    """Edges u, v, d among the members (id, worst, f, new) of each group."""
    def run(batches):
        held, size = [], 0

        def flushed():
            u, v, d = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.float32))], names=["u", "v", "d"])

        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column(0)[row].values
                if len(members) < 2:
                    continue
                held.append(_edges(members.field("id").to_numpy(), _floats(members.field("f").to_pylist()),
                                   members.field("worst").to_numpy(), k,
                                   members.field("new").to_numpy(zero_copy_only=False)))
                size += len(held[-1][0])
                if size > 50_000:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return groups.select("members").mapInArrow(run, "u long, v long, d float")


def _centres(nodes: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction of the vectors of each length."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lens = pa.compute.binary_length(batch.column(0)).to_numpy() // 4
            for width in np.unique(lens).tolist():
                x = _unit(batch.filter(pa.array(lens == width)).column(0))
                sums[width] = sums.get(width, 0.0) + np.append(x.sum(0, dtype=np.float64), len(x))
        for width, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, width, np.int32)), pa.array(np.arange(width + 1, dtype=np.int32)),
                                              pa.array(total)], names=["width", "at", "total"])

    got = nodes.select("f").mapInArrow(run, "width int, at int, total double").groupBy("width", "at").agg(F.sum("total").alias("total"))
    out: dict[int, np.ndarray] = {}
    for r in got.collect():
        out.setdefault(r.width, np.zeros(r.width + 1))[r.at] = r.total
    return {width: (v[:-1] / v[-1]).astype(np.float32) for width, v in out.items()}


def _unit(vectors: pa.Array) -> np.ndarray:
    x = _floats(vectors.to_pylist())
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halved(large: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Rows (node, tree, width, block, part) with each (block, part) cut at its median along a random direction."""
    def run(batches):
        lines: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            tree, width, x = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(5)
            along = np.zeros(batch.num_rows)
            for w in np.unique(width).tolist():
                rows = np.nonzero(width == w)[0]
                own = _unit(x.take(pa.array(rows)))
                for t in np.unique(tree[rows]).tolist():
                    if (t, w) not in lines:
                        lines[t, w] = np.random.default_rng([SEED, w, t, level]).standard_normal(w)
                    along[rows[tree[rows] == t]] = own[tree[rows] == t] @ lines[t, w]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(along)], names=[*names, "along"])

    names = ["node", "tree", "width", "block", "part"]
    placed = saved(large.join(nodes.select("node", "f"), "node").select(*names, "f").mapInArrow(
        run, "node long, tree int, width int, block long, part long, along double"), "along")
    keys = names[1:]
    middle = placed.groupBy(*keys).agg(F.percentile_approx("along", 0.5, 1000).alias("middle"), F.min("along").alias("lo"),
                                       F.max("along").alias("hi"))
    # vectors equal in 32 bits lie at one place: there any half will do
    side = F.when(F.col("lo") == F.col("hi"), F.pmod(F.xxhash64("node", F.lit(level)), F.lit(2))).otherwise(
        ((F.col("along") > F.col("middle")) | ((F.col("middle") == F.col("hi")) & (F.col("along") == F.col("hi")))).cast("long"))
    return placed.join(middle, keys).select("node", *keys[:-1], (F.col("part") * 2 + 1 + side).alias("part"))


def first_edges(nodes: DataFrame, n: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Neighbours inside blocks of up to twice ``leaf`` nodes on the same side of random planes."""
    bits = max(0, min(48, math.ceil(math.log2(max(n, 1) / leaf))))
    centres = _centres(nodes) if bits else {}

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lens = pa.compute.binary_length(batch.column(1)).to_numpy() // 4
            for width in np.unique(lens).tolist():
                own = batch.filter(pa.array(lens == width))
                if width not in planes:
                    rng = np.random.default_rng(SEED + width)
                    planes[width] = rng.standard_normal((trees, width, max(bits, 1)))
                x = _unit(own.column(1)) - centres.get(width, 0)
                for t in range(trees):
                    side = (x @ planes[width][t] > 0)[:, :bits] if bits else np.zeros((len(x), 0), bool)
                    key = (side @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), width, np.int32)),
                         pa.array(key)], names=["node", "tree", "width", "block"])

    keys = ["tree", "width", "block", "part"]
    rows = saved(nodes.select("node", "f").mapInArrow(run, "node long, tree int, width int, block long")
                 .withColumn("part", F.lit(0).cast("long")), "blocks")
    done, level = None, 0
    while True:
        sizes = saved(rows.groupBy(*keys).count().where(F.col("count") > 2 * leaf).drop("count"), "large-blocks")
        if sizes.limit(1).count() == 0:
            break
        small = rows.join(sizes, keys, "left_anti")
        done = small if done is None else done.union(small)
        rows = saved(_halved(rows.join(sizes, keys), nodes, level).select("node", *keys), "halved-blocks")
        level += 1
    every = (rows if done is None else done.select("node", *keys).union(rows.select("node", *keys)))
    member = F.struct(F.col("node").alias("id"), F.lit(float("inf")).cast("float").alias("worst"), "f", F.lit(True).alias("new"))
    groups = every.join(nodes.select("node", "f"), "node").groupBy(*keys).agg(F.collect_list(member).alias("members"))
    return _group_edges(groups, K)


def _best(edges: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of each node; ``old`` is true of edges that were in the graph before."""
    one = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.max("old").alias("old"))
    return _top(one, "u", k, ("d", "v"))


def neighbour_graph(nodes: DataFrame, delta: float = DELTA) -> DataFrame:
    """u, v, d (squared): about the K nearest nodes of each node."""
    n = nodes.count()
    graph = saved(_best(first_edges(nodes, n).withColumn("old", F.lit(False))), "graph")
    floats = nodes.select(F.col("node").alias("id"), "f")
    met = None
    while True:
        mixed = graph.withColumn("h", F.xxhash64("u", "v"))  # any of those that name a node, not the closest
        back = _top(mixed, "v", BACK, ("h", "u")).select(F.col("v").alias("u"), F.col("u").alias("id"))
        around = graph.select("u", F.col("v").alias("id")).union(back).distinct()
        if met is not None:
            around = around.join(met.select("u", "id", F.lit(True).alias("met")), ["u", "id"], "left")
        else:
            around = around.withColumn("met", F.lit(False))
        around = saved(around.select("u", "id", F.coalesce(~F.col("met"), F.lit(True)).alias("new")), "around")
        worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("n")).select(
            F.col("u").alias("id"), F.when(F.col("n") < K, F.lit(float("inf"))).otherwise(F.col("worst")).cast("float").alias("worst"))
        known = saved(floats.join(worst, "id", "left").select(
            "id", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"), "f"), "known")
        fresh = around.where("new").select("u").distinct()
        groups = (around.join(fresh, "u", "left_semi").join(known, "id").groupBy("u")
                  .agg(F.collect_list(F.struct("id", "worst", "f", "new")).alias("members")))
        found = _group_edges(groups, K).withColumn("old", F.lit(False))
        graph = saved(_best(graph.withColumn("old", F.lit(True)).union(found)), "graph")
        if (graph.agg(F.avg((~F.col("old")).cast("int")).alias("x")).first()["x"] or 0.0) < delta:
            return graph
        met = around


def _distances(rows: DataFrame, left: str, right: str, kind: str) -> DataFrame:
    """``rows`` (two ids and two vectors) with the Euclidean distance instead of the vectors."""
    ids = [c for c in rows.columns if c not in (left, right)]

    def values(column):
        if kind == "float":
            return np.frombuffer(b"".join(column.to_pylist()), np.float32), pa.compute.binary_length(column).to_numpy() // 4
        return column.flatten().to_numpy(), pa.compute.list_value_length(column).to_numpy()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, lens), (b, _) = values(batch.column(left)), values(batch.column(right))
            square = (a - b) ** 2
            if (lens == lens[0]).all():
                d = np.sqrt(square.reshape(-1, int(lens[0])).sum(1))
            else:
                d = np.sqrt([p.sum() for p in np.split(square, np.cumsum(lens)[:-1])])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.array(d.astype(np.float64))], names=[*ids, "d"])

    schema = ", ".join(f"{c} long" for c in ids)
    return rows.mapInArrow(run, f"{schema}, d double")


def search(embeddings: DataFrame, queries: str, top: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows of each row that ``queries`` selects."""
    nodes = nodes_of(embeddings, top)
    graph = neighbour_graph(nodes)
    beam = math.ceil(beam * max(1.0, nodes.count() / BEAM_ROWS) ** 0.25)
    back = _top(graph, "v", K, ("d", "u")).select(F.col("v").alias("u"), F.col("u").alias("v"))
    ways = saved(graph.select("u", "v").union(back).distinct().groupBy("u").agg(F.collect_list("v").alias("to")), "ways")
    valid = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
             .where(queries).where("vec_id is not null and v is not null")
             .withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).distinct())
    asked = saved(valid.join(nodes.select("node", "v", "f"), "v").select(
        F.monotonically_increasing_id().alias("q"), "vec_id", "node", F.col("v").alias("qv"), F.col("f").alias("qf")), "queries")
    state = saved(asked.select("q", "node", F.lit(False).alias("opened"), F.lit(0.0).alias("d")), "beam")
    while True:
        ahead = (state.where("not opened").join(ways, state["node"] == ways["u"])
                 .select("q", F.explode("to").alias("node")).distinct()
                 .join(state.select("q", "node"), ["q", "node"], "left_anti"))
        pairs = ahead.join(nodes.select("node", "f"), "node").join(asked.select("q", "qf"), "q").select("q", "node", "qf", "f")
        met = saved(_distances(pairs, "qf", "f", "float").withColumn("opened", F.lit(False)), "met")
        if met.limit(1).count() == 0:
            break
        seen = state.select("q", "node", F.lit(True).alias("opened"), "d").union(met.select("q", "node", "opened", "d"))
        state = saved(_top(seen, "q", beam, ("d", "node")), "beam")
    # the exact distance of the nearest nodes only; twice as many as asked for, for roundings of 32 bits
    nearest = (_top(state, "q", 2 * top + 2, ("d", "node")).select("q", "node").join(nodes.select("node", "v"), "node")
               .join(asked.select("q", "qv"), "q").select("q", "node", "qv", "v"))
    found = (_distances(nearest, "qv", "v", "double").join(nodes.select("node", F.explode("ids").alias("vec_id")), "node")
             .join(asked.select("q", F.col("vec_id").alias("query_id")), "q").where("vec_id <> query_id")
             .groupBy("q", "query_id", "vec_id").agg(F.min("d").alias("score")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
