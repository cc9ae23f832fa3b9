import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloframe.functions.geometry import orientation, sum_sign
from veloframe.operators import spatial

SHAPE = "gid int, name string, ring int, pos int, x double, y double"


def exact_sign(x1, y1, x2, y2, x, y):
    a, b, c, d, e, f = map(Fraction, (x1, y1, x2, y2, x, y))
    v = (a - e) * (d - f) - (b - f) * (c - e)
    return (v > 0) - (v < 0)


def test_orientation_is_exact(spark):
    rng = random.Random(1)
    rows = []
    for k in range(4000):
        x1, y1, x2, y2 = (rng.uniform(-180, 180) for _ in range(4))
        t = rng.random()
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)   # next to the line
        if k % 3 == 0:
            x = math.nextafter(x, 1e9)
        if k % 4 == 0:   # lattice: on the line, or off by the last bit of a sum
            x1, y1, x2, y2 = 0.1 * (k % 7), 0.3, 0.1 * (k % 5) + 0.7, 0.9
            x, y = (x1 + x2) / 2, (y1 + y2) / 2
        if k % 8 == 0:   # exactly on the line
            x1, y1, x2, y2 = 0.25 * (k % 7), 0.5, 0.25 * (k % 5) + 2, 1.0
            x, y = (x1 + x2) / 2, 0.75
        rows.append((x1, y1, x2, y2, x, y))
    rows += [(0.0, 0.0, 1.0, 1.0, 0.5, 0.5), (1.0, 0.0, 1.0, 5.0, 1.0, 7.0), (1e-9, 1e9, -1e9, 3.0, 1e-9, 1e9)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, x double, y double")
    got = [r[0] for r in df.select(F.expr(orientation(*df.columns))).collect()]
    want = [exact_sign(*r) for r in rows]
    assert got == want and want.count(0) > 50


def test_sum_sign(spark):
    rng = random.Random(2)
    rows = [([rng.choice([1, -1]) * 2.0 ** rng.randint(-60, 60) * rng.random() for _ in range(8)],) for _ in range(300)]
    rows += [([1e16, 1.0, -1e16, -1.0],), ([1e16, 1.0, -1e16],), ([],), ([1e16, -1.0, 2.0 ** -70, -1e16, 1.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<double>").select(F.expr(sum_sign("t"))).collect()]
    sums = [sum(map(Fraction, r[0]), Fraction(0)) for r in rows]
    assert got == [(s > 0) - (s < 0) for s in sums]


def exact_inside(points, rings):
    """Even-odd rule in exact arithmetic: numpy where a bound on its error allows, fractions elsewhere."""
    px, py = points
    odd, touch = np.zeros(len(px), bool), np.zeros(len(px), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            left, right = (x1 - px) * (y2 - py), (y1 - py) * (x2 - px)
            det = left - right
            sign = np.sign(det).astype(int)
            for k in np.flatnonzero(np.abs(det) <= 4e-16 * (np.abs(left) + np.abs(right))):
                sign[k] = exact_sign(x1, y1, x2, y2, float(px[k]), float(py[k]))
            span = (y1 > py) != (y2 > py)
            odd ^= span & ((sign > 0) if y2 > y1 else (sign < 0))
            touch |= ((sign == 0) & (px >= min(x1, x2)) & (px <= max(x1, x2)) & (py >= min(y1, y2)) & (py <= max(y1, y2)))
    return odd, touch


def polygons():
    rng = random.Random(3)
    star = [(0.35 * math.cos(k) * (1 + k % 3) - 87.6, 0.35 * math.sin(k) * (1 + k % 3) + 41.9) for k in range(0, 40)]
    lattice = [(-87.70, 41.90), (-87.60, 41.90), (-87.60, 41.95), (-87.65, 41.95), (-87.65, 42.00), (-87.70, 42.00)]
    return {1: [star], 2: [lattice, [(-87.68, 41.92), (-87.66, 41.92), (-87.66, 41.94), (-87.68, 41.94)]],
            3: [[(rng.uniform(-88, -87), rng.uniform(41.5, 42.2)) for _ in range(9)]], 4: [[(-87.65, 41.9), (-87.645, 41.905), (-87.65, 41.91), (-87.655, 41.905)]]}


def frame(spark, shapes):
    return spark.createDataFrame([(g, f"p{g}", r, k, float(x), float(y)) for g, rings in shapes.items() for r, ring in enumerate(rings)
                                  for k, (x, y) in enumerate(ring)], SHAPE)


@pytest.mark.parametrize("cell", [0.01, 0.13])
def test_points_against_exact_arithmetic(spark, cell):
    """Random points, on a lattice of edges and corners, and on the middle lines of cells."""
    n = 200_000 if cell == 0.01 else 50_000
    rng = np.random.default_rng(4)
    shapes = polygons()
    kind = rng.integers(0, 3, n)
    x = np.where(kind == 0, rng.uniform(-88.5, -86.5, n), np.where(kind == 1, np.round(rng.uniform(-88, -87.2, n), 2), (rng.integers(-8800, -8720, n) + 0.5) * 0.01))
    y = np.where(kind == 0, rng.uniform(41, 43, n), np.where(kind == 1, np.round(rng.uniform(41.5, 42.3, n), 2), (rng.integers(4150, 4230, n) + 0.5) * 0.01))
    import pandas as pd
    points = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "lon": x, "lat": y})).repartition(8)
    v = frame(spark, shapes)
    for boundary in (True, False):
        got = spatial.spatial_join(points, v, "lon", "lat", boundary=boundary, cell=cell).select("i", "gid").toPandas()
        assert not got.duplicated().any()
        for g, rings in shapes.items():
            odd, touch = exact_inside((x, y), rings)
            want = np.flatnonzero(odd | touch if boundary else odd & ~touch)
            assert np.array_equal(np.sort(got.loc[got.gid == g, "i"].to_numpy()), want), (g, boundary)


def test_dock_beside_a_middle_line(spark):
    """The corner of the way to the centre lies on an edge: x = -87.7082 at the middle y = 41.975."""
    v = frame(spark, {17: [[(-87.7382, 41.975), (-87.7232, 41.96), (-87.7082, 41.975), (-87.7232, 41.99)]]})
    pts = spark.createDataFrame([(1, -87.7082, 41.97195), (2, -87.7232, 41.975), (3, -87.7082, 41.975)], "i int, lon double, lat double")
    assert {r.i for r in spatial.spatial_join(pts, v, "lon", "lat").collect()} == {2, 3}


def test_cover_grows_with_the_boundary(spark):
    sizes = {}
    for side in (2.0, 8.0):
        square = frame(spark, {1: [[(0.003, 0.002), (side, 0.0), (side + 0.1, side), (0.0, side - 0.01)]]})
        cells = spatial.polygon_cells(square)
        sizes[side] = cells.count()
        area = cells.where("size(edges) = 0").selectExpr("sum(pow(16e0, level)) * 0.0001e0 as a").first().a
        assert side * side * 0.95 < area < side * side * 1.05
        assert cells.groupBy("gid", "level", "cx", "cy").count().where("count > 1").count() == 0
    assert sizes[8.0] < 5 * sizes[2.0] and sizes[8.0] < 20_000   # cells of 0.01 alone would be 640,000


def test_points_that_are_no_points(spark):
    v = frame(spark, {1: [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]})
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, float("nan"), 0.5), (4, float("inf"), 0.5), (5, 0.5, float("-inf"))],
                                "i int, lon double, lat double")
    assert [r.i for r in spatial.spatial_join(pts, v, "lon", "lat").collect()] == [1]
    assert spatial.spatial_join(pts, v, "lon", "lat", "left").count() == 5
    assert spatial.spatial_join(pts, v.limit(0), "lon", "lat", "left").where("gid is null").count() == 5


def ring(n):
    return {1: [[((0.06 + 0.02 * (k % 3)) * math.cos(2 * math.pi * k / n), (0.06 + 0.02 * (k % 3)) * math.sin(2 * math.pi * k / n)) for k in range(n)]]}


def test_dense_edges_get_smaller_cells(spark):
    """The width of a cell follows edges and points; the result does not."""
    rng = np.random.default_rng(5)
    import pandas as pd
    pts = spark.createDataFrame(pd.DataFrame({"i": np.arange(20_000), "lon": rng.uniform(-0.1, 0.1, 20_000), "lat": rng.uniform(-0.1, 0.1, 20_000)}))
    v = frame(spark, ring(6000))
    cell, tests = spatial.fitting_cell(pts, v, "lon", "lat")
    assert cell < spatial.CELL and tests > 0
    assert spatial.fitting_cell(pts.where("i < 20"), frame(spark, ring(12)), "lon", "lat")[0] == spatial.CELL
    own, wide = ({r.i for r in spatial.spatial_join(pts, v, "lon", "lat", cell=c).collect()} for c in (None, spatial.CELL))
    assert own == wide and len(own) > 5000


def plain_inside(px, py, rings):
    """Even-odd rule and touch by the usual formulas in doubles."""
    odd, touch = False, False
    for own in rings:
        for (x1, y1), (x2, y2) in zip(own, own[1:] + own[:1]):
            odd ^= (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
            touch |= ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2))
    return odd, touch


def test_plain_signs_are_those_of_sql(spark):
    """Points next to edges, where doubles round: as the SQL of the queries decides."""
    rng = random.Random(6)
    shapes, pts = {}, []
    for g in range(1, 9):
        own = [(rng.uniform(-87.8, -87.5), rng.uniform(41.7, 42.0)) for _ in range(5)]
        shapes[g] = [own]
        for (x1, y1), (x2, y2) in zip(own, own[1:] + own[:1]):
            for _ in range(60):
                t = rng.random()
                pts.append((len(pts), x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
    v, p = frame(spark, shapes), spark.createDataFrame(pts, "i int, lon double, lat double")
    for boundary in (None, True, False):
        want = set()
        for i, x, y in pts:
            for g, rings in shapes.items():
                odd, touch = plain_inside(x, y, rings)
                if odd if boundary is None else (odd or touch) if boundary else (odd and not touch):
                    want.add((i, g))
        got = {(r.i, r.gid) for r in spatial.spatial_join(p, v, "lon", "lat", boundary=boundary, plain=True).select("i", "gid").collect()}
        assert got == want
    exact = {(r.i, r.gid) for r in spatial.spatial_join(p, v, "lon", "lat", boundary=False).select("i", "gid").collect()}
    assert exact != got
    areas = spatial.areas_with_points(p, v, "lon", "lat", boundary=False, plain=True).where("i is not null")
    assert {(r.i, r.gid) for r in areas.select("i", "gid").collect()} == got
    first = {r.i: r.gid for r in spatial.assign_area(p, v, "lon", "lat", "i", plain=True).collect()}
    assert first == {i: min((g for j, g in got if j == i), default=None) for i, _, _ in pts}


def stacked(n=40):
    """Squares over each other, the later the larger, and one far away."""
    return {g: [[(-g / 100, -g / 100), (g / 100, -g / 100), (g / 100, g / 100), (-g / 100, g / 100)]] for g in range(1, n + 1)} | {99: [[(5, 5), (6, 5), (6, 6), (5, 6)]]}


def stacked_points(spark, n=300):
    rng = random.Random(7)
    pts = [(i % (n - 20), rng.uniform(-0.45, 0.45), rng.uniform(-0.45, 0.45)) for i in range(n)] + [(None, 0.0, 0.0), (n, 0.0, 0.0), (n + 1, None, 0.0)]
    return pts, spark.createDataFrame(pts, "i int, lon double, lat double")


def in_stack(x, y):
    return {g for g in stacked() if x is not None and (max(abs(x), abs(y)) < g / 100 if g < 99 else 5 < min(x, y) and max(x, y) < 6)}


def test_pairs_of_points_and_areas_are_made_after_the_last_shuffle(spark, monkeypatch):
    """A row per position and part of a group goes on, not a row per pair; dealing cells out does not change the pairs."""
    pts, p = stacked_points(spark)
    v = frame(spark, stacked())
    kept, plain = [], spatial.saved
    monkeypatch.setattr(spatial, "saved", lambda df, purpose: kept.append(plain(df, purpose)) or kept[-1])
    want = sorted((g, i) for i, x, y in pts for g in in_stack(x, y) if i is not None)
    for spots, edges, areas in ((20_000, 100_000, 1_000_000), (3, 5, 10)):
        for name, most in (("GROUP_SPOTS", spots), ("GROUP_EDGES", edges), ("AREAS", areas)):
            monkeypatch.setattr(spatial, name, most)
        got = spatial.areas_with_points(p, v, "lon", "lat", plain=True)
        rows = got.select("gid", "name", "i", "lon").collect()
        assert sorted((r.gid, r.i) for r in rows if r.i is not None) == want
        assert [(r.gid, r.name) for r in rows if r.lon is None] == [(99, "p99")]
        pairs = kept[-1].selectExpr("sum(size(_gids)) as n", "count(*) as rows").first()
        assert pairs.n >= len(set(want)) > 2900 and (spots < 20_000 or pairs.rows <= len(pts))


def test_the_first_area_needs_no_test_beyond_a_cover(spark, monkeypatch):
    """Of many polygons over a cell only those before the first that covers it are tested."""
    import pyarrow as pa
    edge = lambda g: [{"x1": 0.0, "y1": 0.001 * g, "x2": 0.01, "y2": 0.001 * g, "left": True}]
    own = [(g, [] if g == 3 else edge(g), True) for g in (9, 8, 7, 6, 5, 4, 3, 2, 1)]
    place = lambda n: {"cx": [0] * n, "cy": [0] * n, "_i": [0] * n, "_j": [0] * n}
    areas = pa.table(place(len(own)) | {"gid": [g for g, _, _ in own], "edges": [e for _, e, _ in own], "centre_in": [c for _, _, c in own]})
    spots = pa.table(place(2) | {"_px": [0.002, 0.003], "_py": [0.0015, 0.004]})
    seen, plain = [], spatial.sides.meets
    monkeypatch.setattr(spatial.sides, "meets", lambda x1, *a: (seen.append(x1.size), plain(x1, *a))[1])
    got = spatial._decide(spots, areas, 0.01, False, True, True)
    assert sum(seen) == 2 and got["_gids"].to_pylist() == [[1], [1]]


def test_smallest_area_of_many(spark, monkeypatch):
    """Repeated keys and NULL keys, positions without an area, cells dealt out: as before, the smallest id, NULL before all."""
    pts, p = stacked_points(spark)
    v = frame(spark, stacked())
    want = {}
    for i, x, y in pts:
        own = min((g for g in in_stack(x, y)), default=None)
        want[i] = own if i not in want else None if None in (own, want[i]) else min(own, want[i])
    for spots, edges in ((20_000, 100_000), (3, 5)):
        monkeypatch.setattr(spatial, "GROUP_SPOTS", spots)
        monkeypatch.setattr(spatial, "GROUP_EDGES", edges)
        got = {r.i: (r.gid, r.name) for r in spatial.assign_area(p, v, "lon", "lat", "i", "name", plain=True).collect()}
        assert got == {i: (g, g and f"p{g}") for i, g in want.items()}
        assert {r.i: r.gid for r in spatial.assign_area(p, v, "lon", "lat", "i").collect()} == want


@pytest.mark.parametrize("plain", [True, False])
def test_large_polygons_are_cut_into_slices(spark, monkeypatch, plain):
    """Parities of slices add up to those of the polygon: rings that are cut, short rings, repeated places, small polygons beside."""
    rng = random.Random(8)
    shapes = {1: ring(3000)[1], 2: [[(rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)) for _ in range(n)] for n in (900, 40, 40)],
              3: [[(0.001 * rng.randint(-90, 90), 0.001 * rng.randint(-90, 90)) for _ in range(500)]], 4: [[(-0.05, -0.05), (0.05, -0.05), (0.05, 0.05)]]}
    corners = [c for rings in shapes.values() for own in rings for c in own]
    pts = [(rng.uniform(-0.12, 0.12), rng.uniform(-0.12, 0.12)) for _ in range(1500)] + [(0.001 * rng.randint(-95, 95), 0.001 * rng.randint(-95, 95)) for _ in range(500)] + corners[::20]
    x, y = np.array(pts).T
    p = spark.createDataFrame([(i, *c) for i, c in enumerate(pts)] + [(-1, None, 0.0), (-2, float("nan"), 0.0)], "i int, lon double, lat double")
    want = {}
    for g, rings in shapes.items():
        if plain:
            own = [plain_inside(*c, rings) for c in zip(x[:300].tolist() + x[-200:].tolist(), y[:300].tolist() + y[-200:].tolist())]
            where = [*range(300), *range(len(x) - 200, len(x))]
        else:
            own, where = zip(*exact_inside((x, y), rings)), range(len(x))
        want |= {(i, g): (bool(o), bool(t)) for i, (o, t) in zip(where, own)}
    v, polygon_cells = frame(spark, shapes), spatial.polygon_cells
    for large, size, spots, bounds in ((400, 100, 50, (True, False)), (100, 700, 1_000_000, (None,))):
        for name, most in (("LARGE", large), ("SLICE", size), ("SLICE_SPOTS", spots)):
            monkeypatch.setattr(spatial, name, most)
        monkeypatch.setattr(spatial, "polygon_cells", lambda vertices, cell, index=polygon_cells: (_few(vertices), index(vertices, cell))[1])
        for boundary in bounds:
            got = {(r.i, r.gid) for r in spatial.spatial_join(p, v, "lon", "lat", boundary=boundary, plain=plain).select("i", "gid").collect()}
            assert {k for k in got if k in want} == {k for k, (o, t) in want.items() if (o if boundary is None else o or t if boundary else o and not t)}


def _few(vertices):
    """Only small polygons get an index, whose rows are an edge in every cell that it crosses."""
    assert vertices.groupBy("gid").count().where("count > 400").count() == 0
