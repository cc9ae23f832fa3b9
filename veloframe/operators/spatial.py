"""Points in polygons.

Polygons arrive as one row per ring vertex: (gid, name, ring, pos, x, y).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import sides
from ..functions.geometry import is_left
from ..session import saved

CELL = 0.01   # degrees
#: A cell of the next level is so many times as wide.
BRANCH = 4
#: Tests of an edge that take as long as one more row of the index, and how often a cell is halved at most.
TESTS_PER_ROW = 20.0
HALVINGS = 8
#: What a group of cells holds, about: positions, edges, tests or pairs.
GROUP_SPOTS = 20_000
GROUP_EDGES = 100_000
GROUP_TESTS = 8_000_000
#: Tests done at once; polygons tested at once where only the first one is wanted.
MATRIX = 200_000
FIRST_TESTS = 64
#: Attributes of so many polygons are broadcast.
AREAS = 1_000_000
#: A polygon of more vertices is worked on in slices of its rings, about so many edges and positions each.
LARGE = 100_000
SLICE = 250_000
SLICE_SPOTS = 1_000_000
#: What names a cell, or the part of one that a group has.
PLACE = ["cx", "cy", "_i", "_j"]


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """One row per edge; rings given without their closing vertex are closed."""
    w = Window.partitionBy("gid", "ring").orderBy("pos")
    ends = F.coalesce(F.lead(F.struct("x", "y")).over(w),
                      F.first(F.struct("x", "y")).over(w))
    return (vertices.select("gid", F.col("x").alias("x1"), F.col("y").alias("y1"),
                            ends.alias("_e"))
            .select("gid", "x1", "y1", F.col("_e.x").alias("x2"), F.col("_e.y").alias("y2"))
            .where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))))


def _levels(vertices: DataFrame, cell: float) -> Column:
    """0, 1, ... up to the level whose cells are as wide as the widest polygon; a scalar subquery, so no job of its own."""
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    widest = vertices.groupBy("gid").agg(span.alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0))).scalar()
    top = F.ceil(F.log(F.greatest(widest / F.lit(cell), F.lit(1.0))) / F.lit(math.log(BRANCH)) + 1e-9)
    return F.sequence(F.lit(0), top.cast("int"))


def _x_at(y: Column) -> Column:
    """Of the edge at an ordinate held inside its own range."""
    held = F.greatest(F.least(y, F.greatest("y1", "y2")), F.least("y1", "y2"))
    return F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(
        (F.col("x2") - F.col("x1")) * (held - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))


def _crossings(vertices: DataFrame, cell: float, levels: Column) -> DataFrame:
    """Each edge once per cell (level, cx, cy; ``_c`` wide) that it crosses."""
    slack, c = F.lit(1e-6), F.col("_c")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    many = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (polygon_edges(vertices).repartition(many, "gid", "x1", "y1")   # the edges of one ring leave its task
            .withColumn("level", F.explode(levels))
            .withColumn("_c", F.lit(cell) * F.pow(F.lit(float(BRANCH)), "level"))
            .withColumn("cy", F.explode(F.sequence(F.floor(low / c - slack), F.floor(high / c + slack)))))
    flat = F.col("y1") == F.col("y2")
    first, last = _x_at(F.col("cy") * c), _x_at((F.col("cy") + 1) * c)
    west = F.when(flat, F.least("x1", "x2")).otherwise(F.least(first, last))
    east = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(first, last))
    return rows.withColumn("cx", F.explode(F.sequence(F.floor(west / c - slack), F.floor(east / c + slack))))


def _load(spots: DataFrame, vertices: DataFrame, x: str, y: str, first: bool = False) -> tuple[float, float, float, int, int]:
    """The width of a cell (see :func:`fitting_cell`); about how many tests, pairs and edges in cells it makes; positions."""
    c = F.lit(CELL)
    edges = _crossings(vertices, CELL, F.array(F.lit(0))).groupBy("cx", "cy").agg(F.count("*").alias("_edges"))
    held = (spots.groupBy(F.floor(F.col(x) / c).alias("_x0"), F.floor(F.col(y) / c).alias("_y0")).agg(F.count("*").alias("_spots")))
    each = F.least("_edges", F.lit(FIRST_TESTS)) if first else F.col("_edges")
    boxes = vertices.groupBy("gid").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("_box"))
    rows, tests, count, cells, boxes = (
        edges.join(held, (F.col("cx") == F.col("_x0")) & (F.col("cy") == F.col("_y0")), "full")
        .agg(F.sum("_edges"), F.sum(each.cast("double") * F.col("_spots")), F.sum("_spots"), F.count("_spots"),
             boxes.agg(F.sum("_box")).scalar()).first())
    wanted = math.sqrt((tests or 0.0) / TESTS_PER_ROW / (rows or 1))
    finer = 2 ** min(round(math.log2(max(wanted, 1.0))), HALVINGS)
    pairs = (boxes or 0.0) / CELL ** 2 * (count or 0) / (cells or 1)
    return CELL / finer, (tests or 0.0) / finer, pairs, (rows or 0) * finer, count or 0


def fitting_cell(spots: DataFrame, vertices: DataFrame, x: str, y: str) -> tuple[float, float]:
    """``CELL``, halved where edges lie so dense that testing them costs more than a finer index.

    Half the width is about twice the rows of the index and half the tests.  Both are counted on the cells of
    ``CELL``; the width never changes a result.  Also the number of tests, about.
    """
    return _load(spots, vertices, x, y)[:2]


def polygon_cells(vertices: DataFrame, cell: float = CELL) -> DataFrame:
    """Index rows (gid, level, cx, cy, edges, centre_in): the cells that cover a polygon.

    Cells that an edge crosses are small (level 0).  They hold only the edges that cross them and say
    whether their centre lies inside, so a point is decided by the edges between it and
    the centre.  Inside a polygon a cell without an edge is as large as its place among the
    crossed cells of the next level allows (``BRANCH`` times wider each level): it holds no
    edges, and all its points are inside.  The rows grow with the boundary of a polygon,
    not with its area.  An edge is repeated once per cell it crosses, whatever the size of its polygon.
    """
    c, x_at = F.col("_c"), _x_at
    crossed = _crossings(vertices, cell, _levels(vertices, cell))
    # where the edge meets the row's middle line counts once, in the cell of that place: in the centre's own cell by the
    # exact side, elsewhere by the cell, which is far enough from the centre to be sure
    mid_x, mid_y = (F.col("cx") + 0.5) * c, (F.col("cy") + 0.5) * c
    counted = (crossed.withColumn("_mx", mid_x).withColumn("_my", mid_y)
               .withColumn("_meets", (F.col("y1") > F.col("_my")) != (F.col("y2") > F.col("_my")))
               .withColumn("_left", F.expr(f"case when _meets then {is_left('x1', 'y1', 'x2', 'y2', '_mx', '_my')} end"))
               .withColumn("_here", F.col("_meets") & (F.floor(x_at(F.col("_my")) / c) == F.col("cx"))))
    cells = counted.groupBy("gid", "level", "cy", "cx").agg(
        F.collect_list(F.when(F.col("level") == 0, F.struct("x1", "y1", "x2", "y2", F.col("_left").alias("left")))).alias("edges"),
        F.count_if("_here").alias("_all"),
        F.count_if(F.col("_here") & (F.col("_left") == (F.col("y2") > F.col("y1")))).alias("_right"),
        F.lit(True).alias("_crossed"))
    # cells inside a crossed one of the next level that may hold no edge themselves
    part = F.sequence(F.lit(0), F.lit(BRANCH - 1))
    inner = (cells.where("level > 0").select("gid", (F.col("level") - 1).alias("level"), F.col("cy").alias("_y"), F.col("cx").alias("_x"))
             .withColumn("_i", F.explode(part)).withColumn("_j", F.explode(part))
             .select("gid", "level", (F.col("_y") * BRANCH + F.col("_i")).alias("cy"), (F.col("_x") * BRANCH + F.col("_j")).alias("cx"),
                     F.expr("cast(array() as array<struct<x1: double, y1: double, x2: double, y2: double, left: boolean>>)").alias("edges"),
                     F.lit(0).cast("long").alias("_all"), F.lit(0).cast("long").alias("_right"), F.lit(False).alias("_crossed")))
    cells = cells.union(inner)
    row = Window.partitionBy("gid", "level", "cy").orderBy(F.col("cx").desc(), F.col("_crossed").desc())
    placed = (cells.withColumn("_beyond", F.coalesce(F.sum("_all").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_twice", F.coalesce(F.lag("cx").over(row) == F.col("cx"), F.lit(False)))
              .withColumn("centre_in", (F.col("_beyond") + F.col("_right")) % 2 == 1))
    return (placed.where((F.col("_crossed") & (F.col("level") == 0)) | (~F.col("_crossed") & ~F.col("_twice") & F.col("centre_in")))
            .select("gid", "level", "cx", "cy", "edges", "centre_in"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _cells_of(table: pa.Table, rank: np.ndarray | None = None) -> tuple[pa.Table, dict[tuple[int, ...], tuple[int, int]]]:
    """The rows by cell (and rank), and where each cell begins and ends."""
    keys = [table[c].to_numpy() for c in PLACE]
    order = np.lexsort(keys if rank is None else [rank, *keys])
    keys = np.stack([k[order] for k in keys], axis=1)
    cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    ends = np.append(cuts[1:], len(keys))
    return table.take(pa.array(order)).combine_chunks(), {tuple(keys[i].tolist()): (int(i), int(j)) for i, j in zip(cuts, ends)}


def _held(px: np.ndarray, py: np.ndarray, edges: list[np.ndarray], starts: np.ndarray, centre_in: np.ndarray, my: float,
          boundary: bool | None, plain: bool) -> np.ndarray:
    """Whether each point is in each polygon; ``starts`` says where the edges of a polygon begin."""
    out = np.empty((len(px), len(starts)), bool)
    block = max(1, MATRIX // max(1, len(edges[0])))
    for i in range(0, len(px), block):
        met, on = sides.meets(*(e[None, :] for e in edges), px[i:i + block, None], py[i:i + block, None], my, plain, boundary is not None)
        if len(starts) < len(edges[0]):
            met = np.logical_xor.reduceat(met, starts, axis=1)
            on = on if on is None else np.logical_or.reduceat(on, starts, axis=1)
        inside = met != centre_in[None, :]
        out[i:i + block] = inside if on is None else inside | on if boundary else inside & ~on
    return out


def _decide(spots: pa.Table, areas: pa.Table, cell: float, boundary: bool | None, plain: bool, first: bool) -> pa.Table:
    """For the spots of some cells the ids of the polygons that hold them (``first``: the smallest one)."""
    gids, found, polygons = _whole(areas["gid"]), [], []
    rank = None
    if first and areas.num_rows:
        rank = np.empty(areas.num_rows, np.int64)
        rank[pc.array_sort_indices(gids, null_placement="at_start").to_numpy()] = np.arange(areas.num_rows)
    if spots.num_rows and areas.num_rows:
        (spots, places), (areas, own) = _cells_of(spots), _cells_of(areas, rank)
        px, py, centre_in = (t[c].to_numpy() for t, c in ((spots, "_px"), (spots, "_py"), (areas, "centre_in")))
        gids, lists = _whole(areas["gid"]), _whole(areas["edges"])
        begins = lists.offsets.to_numpy().astype(np.int64)
        fields = [pc.fill_null(f, False).to_numpy(zero_copy_only=False) if pa.types.is_boolean(f.type) else f.to_numpy() for f in lists.values.flatten()]
        for at in sorted(places.keys() & own.keys(), key=places.get):
            (p, p_end), (a, a_end) = places[at], own[at]
            my = (at[PLACE.index("cy")] + 0.5) * cell
            holds = np.repeat(centre_in[a:a_end][None, :], p_end - p, axis=0)
            counts = np.diff(begins[a:a_end + 1])
            if first and (covers := np.flatnonzero(counts == 0)).size:   # nothing beyond the first cover can be the smallest
                holds, counts = holds[:, :covers[0] + 1], counts[:covers[0] + 1]
            todo, rows = np.arange(p_end - p), np.flatnonzero(counts)
            step = FIRST_TESTS if first else max(1, len(rows))
            for k in range(0, len(rows), step):
                some = rows[k:k + step]
                starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
                edges = [f[begins[a + some[0]]:begins[a + some[-1] + 1]] for f in fields]
                inside = _held(px[p:p_end][todo], py[p:p_end][todo], edges, starts, centre_in[a + some], my, boundary, plain)
                holds[np.ix_(todo, some)] = inside
                if first:   # what a polygon of this step holds needs no later one
                    todo = todo[~inside.any(axis=1)]
                    if not todo.size:
                        break
            if first:
                hit = np.flatnonzero(holds.any(axis=1))
                found.append(p + hit)
                polygons.append(a + holds[hit].argmax(axis=1))
            else:
                i, j = np.nonzero(holds)
                found.append(p + i)
                polygons.append(a + j)
    found, polygons = (np.concatenate([np.empty(0, np.int64), *v]) for v in (found, polygons))
    at, counts = np.unique(found, return_counts=True)   # the rows of a spot stand together
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.table({"_px": spots["_px"].take(pa.array(at)), "_py": spots["_py"].take(pa.array(at)),
                     "_gids": pa.ListArray.from_arrays(pa.array(offsets), gids.take(pa.array(polygons)))})


def _spots(points: DataFrame, x: str, y: str) -> DataFrame:
    endless = float("inf")
    return (points.select(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct()
            .where((F.abs("_px") < endless) & (F.abs("_py") < endless)))


def _slices(vertices: DataFrame, large: list[Row]) -> tuple[DataFrame, list[tuple], dict[int, tuple], dict[int, np.ndarray]]:
    """The rings of large polygons, cut: vertices with their slice; (slice, polygon, box) of each; the first vertex of the
    next slice, for slices of rings that are cut; and per polygon the first vertices of such slices, in order.

    A slice and the edge from its end back to its beginning are a closed ring; so are these edges alone, which are added once more.
    What is collected here is a row per slice.
    """
    spark, kind = vertices.sparkSession, vertices.schema["gid"].dataType.simpleString()
    numbers = spark.createDataFrame([(r.gid, n) for n, r in enumerate(large)], f"_gid {kind}, _no int")
    own = (vertices.join(F.broadcast(numbers), F.col("gid").eqNullSafe(F.col("_gid"))).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
           .select("_no", F.col("ring").alias("_ring"), F.col("pos").cast("double").alias("_at"), "pos", "x", "y"))
    whole = F.struct("_no", "_ring")
    rings = (own.groupBy("_no", "_ring").agg(F.count("*").alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high"))
             .where(F.col("n") > SLICE).orderBy(whole).collect())
    count, cuts, cut_of = 0, [], {}
    for r in rings:
        k = math.ceil(r.n / SLICE)
        cuts.append((r._no, r._ring, count, k, r.low, r.high))
        cut_of |= dict.fromkeys(range(count, count + k), len(cuts) - 1)
        count += k
    shares = []
    for no, r in enumerate(large):   # shorter rings stay whole
        k = math.ceil(max(1, r.n - sum(c.n for c in rings if c._no == no)) / SLICE)
        shares.append((no, count, k))
        count += k
    ring = vertices.schema["ring"].dataType.simpleString()
    cut = spark.createDataFrame(cuts, f"_no int, _ring {ring}, _from int, _k int, _low double, _high double")
    rest = spark.createDataFrame(shares, "_no int, _base int, _parts int")
    place = F.floor((F.col("_at") - F.col("_low")) * (F.col("_k") / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))))
    own = (own.join(F.broadcast(cut.withColumnsRenamed({"_no": "_n", "_ring": "_r"})), F.col("_no").eqNullSafe(F.col("_n")) & F.col("_ring").eqNullSafe(F.col("_r")), "left")
           .join(F.broadcast(rest), "_no")
           .select("_no", F.when(F.col("_k").isNotNull(), F.col("_from") + F.greatest(F.lit(0), F.least(F.coalesce(place, F.lit(0)), F.col("_k") - 1)))
                   .otherwise(F.col("_base") + F.pmod(F.xxhash64("_ring"), F.col("_parts"))).cast("int").alias("_slice"), "_ring", "pos", "x", "y"))
    found = {r._slice: r for r in own.groupBy("_slice").agg(
        F.min("_no").alias("no"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.when(F.count("pos") == F.count("*"), F.min("pos")).alias("pos")).collect()}   # no struct, so it hashes
    begins = spark.createDataFrame([(k, r.pos) for k, r in found.items()], f"_s int, _p {vertices.schema['pos'].dataType.simpleString()}")
    head = {r._slice: (r.head.x, r.head.y) for r in own.join(F.broadcast(begins), (F.col("_slice") == F.col("_s")) & F.col("pos").eqNullSafe(F.col("_p")))
            .groupBy("_slice").agg(F.min(F.struct("x", "y")).alias("head")).collect()}
    boxes, following, heads = [], {}, {}
    for c, (no, *_) in enumerate(cuts):
        mine = sorted(k for k in found if cut_of.get(k) == c)
        for k, later in zip(mine, mine[1:] + mine[:1]):
            following[k] = (*head[later], *head[k])
        heads.setdefault(no, []).append(np.array([head[k] for k in mine]))
    for k, r in found.items():
        xs, ys = [r.x0, r.x1, *following.get(k, ())[:1]], [r.y0, r.y1, *following.get(k, ())[1:2]]
        boxes.append((k, r.no, min(xs), max(xs), min(ys), max(ys)))
    return own, boxes, following, heads


def _ring_edges(table: pa.Table, following: dict[int, tuple]) -> tuple[list[np.ndarray], int]:
    """The edges of a slice, and how many of them are edges of the polygon."""
    key = table["_slice"][0].as_py()
    table = table.append_column("_o", pa.array(pc.rank(_whole(table["_ring"]), tiebreaker="dense")))
    order = pc.sort_indices(table, [(c, "ascending") for c in ("_o", "pos", "x", "y")], null_placement="at_start")
    x, y, ring = (table[c].take(order).to_numpy() for c in ("x", "y", "_o"))
    begins = np.flatnonzero(np.concatenate(([True], ring[1:] != ring[:-1])))
    x2, y2 = np.append(x[1:], 0.0), np.append(y[1:], 0.0)
    ends = np.append(begins[1:], len(x)) - 1
    x2[ends], y2[ends] = x[begins], y[begins]
    edges, solid = [x, y, x2, y2], len(x)
    if key in following:   # a cut ring: on to the next slice, and back by an edge that is counted twice
        next_x, next_y, own_x, own_y = following[key]
        x2[-1], y2[-1] = next_x, next_y
        edges = [np.append(v, w) for v, w in zip(edges, (own_x, own_y, next_x, next_y))]
    return edges, solid


def _large_hits(spots: DataFrame, vertices: DataFrame, large: list[Row], boundary: bool | None, plain: bool) -> DataFrame:
    """The hits of polygons with very many vertices: parities of slices of their rings, added.

    An edge goes to one task, with the positions in the box of its slice; an index would repeat it in every cell that it crosses.
    """
    spark, kind = spots.sparkSession, vertices.schema["gid"].dataType.simpleString()
    own, boxes, following, heads = _slices(vertices, large)
    band = max([*((b[5] - b[4]) / 4 for b in boxes), 1e-9])
    boxes = spark.createDataFrame(boxes, "_slice int, _no int, _x0 double, _x1 double, _y0 double, _y1 double")
    boxes = F.broadcast(boxes.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_y0") / band), F.floor(F.col("_y1") / band)))))
    near = (spots.withColumn("_band", F.floor(F.col("_py") / band)).join(boxes, "_band")
            .where(F.col("_px").between(F.col("_x0"), F.col("_x1")) & F.col("_py").between(F.col("_y0"), F.col("_y1"))))
    parts = [(r._slice, math.ceil(r.n / SLICE_SPOTS)) for r in near.groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    parts = F.broadcast(spark.createDataFrame(parts, "_slice int, _parts int"))
    lines = (own.join(parts, "_slice").select("_slice", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_no", "_ring", "pos", "x", "y"))
    near = near.join(parts, "_slice").select("_slice", F.pmod(F.xxhash64("_px", "_py"), F.col("_parts")).cast("int").alias("_part"), "_px", "_py")
    out = "_no int, _px double, _py double, _odd boolean, _on boolean"

    def told(no: int, px: np.ndarray, py: np.ndarray, odd: np.ndarray, on: np.ndarray) -> pa.Table:
        some = odd | on
        return pa.table({"_no": pa.array(np.full(some.sum(), no, np.int32)), "_px": px[some], "_py": py[some], "_odd": odd[some], "_on": on[some]})

    def slice_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return told(0, *(np.empty(0, t) for t in (float, float, bool, bool)))
        px, py = (left[c].to_numpy() for c in ("_px", "_py"))
        edges, solid = _ring_edges(right, following)
        return told(right["_no"][0].as_py(), px, py, *sides.strip_parity(*edges, px, py, plain, solid))

    def back(batches):
        for batch in batches:
            px, py = (batch.column(c).to_numpy() for c in ("_px", "_py"))
            for no, rings in heads.items() if len(px) else ():
                edges = [np.concatenate(v) for v in zip(*((*r.T, *np.roll(r, -1, axis=0).T) for r in rings))]
                yield from told(no, px, py, *sides.strip_parity(*edges, px, py, plain, 0)).to_batches()

    found = near.groupBy("_slice", "_part").cogroup(lines.groupBy("_slice", "_part")).applyInArrow(slice_of, out)
    if heads:
        found = found.union(spots.select("_px", "_py").mapInArrow(back, out))
    inside = F.count_if("_odd") % 2 == 1
    hit = inside if boundary is None else inside | F.bool_or("_on") if boundary else inside & ~F.bool_or("_on")
    numbers = F.broadcast(spark.createDataFrame([(n, r.gid) for n, r in enumerate(large)], f"_no int, gid {kind}"))
    return (found.groupBy("_no", "_px", "_py").agg(hit.alias("_hit")).where("_hit").join(numbers, "_no")
            .select("_px", "_py", F.array("gid").alias("_gids")))


def _hits(points: DataFrame, vertices: DataFrame, x: str, y: str, boundary: bool | None = True, cell: float | None = None,
          plain: bool = False, first: bool = False) -> DataFrame:
    """Rows (_px, _py, _gids): the ids of polygons that hold a position; a position may have several rows.

    Polygons of very many vertices are worked on in slices, the others by cells.
    """
    spots = _spots(points, x, y)
    vertices = vertices.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    sizes = vertices.groupBy("gid").agg(F.count("*").alias("n"))
    all_of, large = sizes.agg(F.count("*"), F.collect_list(F.when(F.col("n") > LARGE, F.struct("gid", "n")))).first()
    if not large:
        return _cell_hits(spots, vertices, boundary, cell, plain, first)
    hits = _large_hits(spots, vertices, large, boundary, plain)
    if len(large) == all_of:
        return hits
    own = vertices.sparkSession.createDataFrame([(r.gid,) for r in large], f"_gid {vertices.schema['gid'].dataType.simpleString()}")
    small = vertices.join(F.broadcast(own), F.col("gid").eqNullSafe(F.col("_gid")), "left_anti")
    return hits.union(_cell_hits(spots, small, boundary, cell, plain, first))


def _cell_hits(spots: DataFrame, vertices: DataFrame, boundary: bool | None, cell: float | None, plain: bool, first: bool) -> DataFrame:
    """The hits by cells.

    Positions and index rows meet in groups of cells.  A cell with very many positions or edges is dealt to several groups:
    parts of its positions by parts of its polygons.
    """
    groups = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dense = True
    if cell is None:
        cell, tests, pairs, rows, count = _load(spots, vertices, "_px", "_py", first)
        groups = max(groups, math.ceil(max(tests, 0 if first else pairs) / GROUP_TESTS), math.ceil(count / GROUP_SPOTS), math.ceil(rows / GROUP_EDGES))
        dense = count > GROUP_SPOTS or rows > GROUP_EDGES
    c, shift = F.lit(cell), BRANCH.bit_length() - 1
    spots = spots.withColumn("cx", F.floor(F.col("_px") / c)).withColumn("cy", F.floor(F.col("_py") / c))
    # a large cell is named by the small one, so that all levels agree on every point
    wide = (spots.select(F.col("cx").alias("_x0"), F.col("cy").alias("_y0")).distinct().withColumn("level", F.explode(_levels(vertices, cell)))
            .withColumn("cx", F.expr(f"shiftright(_x0, {shift} * level)")).withColumn("cy", F.expr(f"shiftright(_y0, {shift} * level)")))
    areas = (wide.join(polygon_cells(vertices, cell), ["level", "cx", "cy"])
             .select(F.col("_x0").alias("cx"), F.col("_y0").alias("cy"), "gid", "edges", "centre_in"))
    parts = {"_i": F.lit(1), "_j": F.lit(1)}
    if dense:
        many = spots.groupBy("cx", "cy").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_SPOTS)
        full = _crossings(vertices, cell, F.array(F.lit(0))).groupBy("cx", "cy").agg(F.count("*").alias("_m")).where(F.col("_m") > GROUP_EDGES)
        heavy = F.broadcast(many.join(full, ["cx", "cy"], "full"))   # a row per GROUP_SPOTS positions or GROUP_EDGES edges at most
        spots, areas = spots.join(heavy, ["cx", "cy"], "left"), areas.join(heavy, ["cx", "cy"], "left")
        parts = {k: F.ceil(F.coalesce(F.col(n), F.lit(1)) / most) for k, n, most in (("_i", "_n", GROUP_SPOTS), ("_j", "_m", GROUP_EDGES))}
    every = {k: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)) for k, n in parts.items()}
    spots = spots.withColumn("_i", F.pmod(F.xxhash64("_px", "_py"), parts["_i"])).withColumn("_j", every["_j"])
    areas = areas.withColumn("_j", F.pmod(F.xxhash64("gid"), parts["_j"])).withColumn("_i", every["_i"])
    group = F.pmod(F.xxhash64(*PLACE), F.lit(groups)).alias("_group")
    kind = vertices.schema["gid"].dataType.simpleString()

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        return _decide(left, right, cell, boundary, plain, first)

    return (spots.select(group, *PLACE, "_px", "_py").groupBy("_group")
            .cogroup(areas.select(group, *PLACE, "gid", "edges", "centre_in").groupBy("_group"))
            .applyInArrow(decide, f"_px double, _py double, _gids array<{kind}>"))


def _with_gid(points: DataFrame, hits: DataFrame, x: str, y: str, how: str, gid: str) -> DataFrame:
    """Points with the polygons of their position, a row each."""
    joined = points.join(hits, (points[x] == hits["_px"]) & (points[y] == hits["_py"]), how)
    each = F.explode_outer if how == "left" else F.explode
    return joined.select(*[points[c] for c in points.columns], each("_gids").alias(gid))


def _attributes(vertices: DataFrame, keep: Sequence[str], prefix: str = "") -> DataFrame:
    """Distinct attributes of polygons; broadcast up to ``AREAS`` rows, since the rows they are joined to are many more."""
    attrs = vertices.select(*[F.col(c).alias(prefix + c) for c in dict.fromkeys(keep)]).distinct()
    return F.broadcast(attrs) if attrs.limit(AREAS + 1).count() <= AREAS else attrs


def spatial_join(points: DataFrame, vertices: DataFrame, x: str, y: str, how: str = "inner",
                 boundary: bool | None = True, cell: float | None = None,
                 keep: Sequence[str] = ("gid",), plain: bool = False) -> DataFrame:
    """Pairs of points and the polygons holding them.

    An equi-join on grid cells of a few sizes finds candidates; the edges that cross the cell of a point decide, by exact
    signs, in Arrow batches of many cells.  Repeated positions are tested once.  ``boundary`` says whether points on an edge count
    (None: by the even-odd rule alone); ``left`` keeps points in no polygon with NULL attributes.  The polygons of a position
    are joined back on the position as an array.  ``plain`` decides by the usual formulas in
    doubles instead, rounding errors included, as SQL engines do: crossings where
    ``px < (x2 - x1) * (py - y1) / (y2 - y1) + x1``, on an edge where the plain determinant is 0.
    """
    if list(keep) == ["gid"]:
        return _with_gid(points, _hits(points, vertices, x, y, boundary, cell, plain), x, y, how, "gid")
    named = vertices.where("gid is not null")   # attributes are joined by the id
    pairs = _with_gid(points, _hits(points, named, x, y, boundary, cell, plain), x, y, how, "_gid")
    return (pairs.join(_attributes(named, ["gid", *keep], "_of_"), F.col("_gid") == F.col("_of_gid"), how)
            .select(*[pairs[c] for c in points.columns], *[F.col(f"_of_{c}").alias(c) for c in keep]))


def areas_with_points(points: DataFrame, vertices: DataFrame, x: str, y: str, boundary: bool | None = True,
                      cell: float | None = None, keep: Sequence[str] = ("gid", "name"), plain: bool = False) -> DataFrame:
    """Each polygon with its points; a polygon without points stays, with NULLs.

    The ids at each position are saved, so that polygons without points are known and pairs are made once, after the last shuffle.
    """
    areas = _attributes(vertices, keep)
    hits = saved(_hits(points, vertices.where("gid is not null"), x, y, boundary, cell, plain), "areas")
    pairs = _with_gid(points, hits, x, y, "inner", "_gid")
    held = areas.join(pairs, areas["gid"] == pairs["_gid"]).drop("_gid")
    some = hits.select(F.explode("_gids").alias("_gid")).distinct()
    return held.union(areas.join(some, areas["gid"] == some["_gid"], "left_anti").select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema]))


def assign_area(points: DataFrame, vertices: DataFrame, x: str, y: str, key: str,
                name: str | None = None, cell: float | None = None, plain: bool = False) -> DataFrame:
    """For each point strictly inside a polygon its id (and name).  Where several
    polygons hold a point, the smallest id wins; in a cell no polygon beyond the first that covers it is tested."""
    keep = ["gid"] + ([name] if name else [])
    if name:
        vertices = vertices.where("gid is not null")
    hits = _hits(points, vertices, x, y, False, cell, plain, first=True)
    best = hits.groupBy("_px", "_py").agg(F.min(F.struct(F.col("_gids")[0].alias("gid"))).alias("_m"))
    located = (points.select(F.col(key).alias(key), F.col(x).alias("_x"), F.col(y).alias("_y"))
               .join(best, (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")), "left").select(key, F.col("_m.gid").alias("gid")))
    if name:
        located = located.join(_attributes(vertices, keep), "gid", "left")
    first = F.min(F.struct(*keep)).alias("_m")
    best = located.groupBy(key).agg(first)
    return best.select(key, *[F.col("_m")[k].alias(k) for k in keep])


def with_area_geometry(metrics: DataFrame, vertices: DataFrame, area: str, name: str = "name",
                       how: str = "inner") -> DataFrame:
    """Area metrics repeated over the vertices of their polygon, for maps."""
    shape = vertices.select(F.col(name).alias(area), "gid", "ring", "pos", "x", "y")
    return metrics.join(shape, area, how)


def area_id_geometry(totals: DataFrame, vertices: DataFrame) -> DataFrame:
    """Totals per polygon id: attributes (left), vertices (inner), distinct rows."""
    attrs = vertices.select("gid", "name").distinct()
    shape = vertices.select("gid", "ring", "pos", "x", "y")
    return (totals.join(attrs, "gid", "left").join(shape, "gid")
            .select("counts", "total_days", "avg", "name", "ring", "pos", "x", "y").distinct())
