import datetime
import struct

import numpy as np
import pytest

from veloframe.sources import shapefile

SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
HOLE = [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)]


def record(kind, parts, tail=b""):
    points = [p for r in parts for p in r]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    body = struct.pack("<i4d", kind, 0, 0, 1, 1) + struct.pack("<ii", len(parts), len(points))
    return body + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) + tail


def put(folder, bodies, fields, rows, name="a", page=None):
    """A shapefile by hand: record bodies, (name, kind, length, decimals), and raw rows of the table."""
    shp, shx, at = b"", b"", 100
    for i, b in enumerate(bodies):
        shp += struct.pack(">ii", i + 1, len(b) // 2) + b
        shx += struct.pack(">ii", at // 2, len(b) // 2)
        at += len(b) + 8
    head = struct.pack(">i20xi", 9994, at // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    table = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in fields)
    width = 1 + sum(w for _, _, w, _ in fields)
    dbf = struct.pack("<4BIHH20x", 3, 99, 1, 1, len(rows), 32 + len(table) + 1, width) + table + b"\r" + b"".join(rows)
    for ending, data in ((".shp", head + shp), (".shx", head + shx), (".dbf", dbf)):
        (folder / f"{name}{ending}").write_bytes(data)
    if page:
        (folder / f"{name}.cpg").write_text(page)
    return str(folder / f"{name}.shp")


FIELDS = [("gid", "N", 4, 0), ("community", "C", 8, 0), ("area", "F", 8, 2), ("since", "D", 8, 0), ("open", "L", 1, 0)]
ROWS = [b" " + b"   1" + b"LOOP    " + b"   12.50" + b"20240131" + b"T", b" " + b"   2" + "É É".encode("latin-1").ljust(8) + b"********" + b"00000000" + b"?",
        b"*" + b"   3" + b"GONE    " + b"    1.00" + b"20240131" + b"F", b" " + b"    " + b"        " + b"   -1e-2" + b"        " + b"f"]


def test_shapes_and_attributes(spark, tmp_path):
    z = record(15, [SQUARE], struct.pack("<2d5d", 0, 0, *[7.0] * 5))
    path = put(tmp_path, [record(5, [SQUARE, HOLE]), z, record(5, [SQUARE]), struct.pack("<i", 0)], FIELDS, ROWS)
    for split in (1, 1 << 20):
        got = {r._record: r for r in shapefile.read_shapes(spark, path, split_bytes=split).collect()}
        assert sorted(got) == [0, 1, 3]
        assert [[tuple(p) for p in r] for r in got[0]._parts] == [SQUARE, HOLE]
        assert got[1]._shape == 15 and [tuple(p) for p in got[1]._parts[0]] == SQUARE and got[3]._parts is None
        assert tuple(got[0])[3:] == (1, "LOOP", 12.5, datetime.date(2024, 1, 31), True)
        assert tuple(got[1])[3:] == (2, "É É", None, None, None)
        assert tuple(got[3])[3:] == (None, "", -0.01, None, False)
    assert shapefile.read_shapes(spark, path, split_bytes=1).rdd.getNumPartitions() == 4
    few = shapefile.read_shapes(spark, path, ["since"])
    assert few.columns == ["_record", "_shape", "_parts", "since"] and few.count() == 3
    with pytest.raises(Exception, match="no column nope"):
        shapefile.read_shapes(spark, path, ["nope"]).collect()


def test_points_lines_and_encoding(spark, tmp_path):
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    many = struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 1.0, 2.0, 3.0, 4.0)
    fields = [("name", "C", 6, 0)]
    path = put(tmp_path, [point, many, record(3, [SQUARE[:2]])], fields, [b" " + "Łód".encode().ljust(6)] * 3, page="UTF-8")
    got = shapefile.read_shapes(spark, path).orderBy("_record").collect()
    assert [[[tuple(p) for p in part] for part in r._parts] for r in got] == [[[(3.0, 4.0)]], [[(1.0, 2.0), (3.0, 4.0)]], [SQUARE[:2]]]
    assert got[0].name == "Łód"
    with pytest.raises(Exception, match="not a polygon"):
        shapefile.read_boundary_shapes(spark, path, "name", "name").collect()


def test_round_trip_and_many_files(spark, tmp_path, monkeypatch):
    rows = [(g, f"area {g}", ring, pos, x + g, y) for g in range(40) for ring, r in enumerate([SQUARE, HOLE]) for pos, (x, y) in enumerate(r)]
    vertices = spark.createDataFrame(rows, "gid int, name string, ring int, pos int, x double, y double").repartition(5)
    monkeypatch.setattr(shapefile, "FILE_VERTICES", 100)
    assert shapefile.write_boundary_shapes(vertices, str(tmp_path / "out")) > 1
    got = shapefile.read_boundary_shapes(spark, str(tmp_path / "out"), split_bytes=300)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert shapefile.read_boundary_shapes(spark, f"file://{tmp_path}/out").count() == len(rows)


def test_broken_files_name_the_byte(spark, tmp_path):
    good = record(5, [SQUARE])
    rows = [b" " + b"   1"] * 2
    cases = {"short": ([good, good[:-16]], "record at byte 236"), "kind": ([good, struct.pack("<i", 77)], "kind 77"),
             "order": ([good, good[:36] + struct.pack("<iiii", 2, 3, 0, -1) + good[48:] + b"1234"], "parts do not ascend")}
    for name, (bodies, message) in cases.items():
        path = put(tmp_path, bodies, [("gid", "N", 4, 0)], rows, name)
        with pytest.raises(Exception, match=message):
            shapefile.read_shapes(spark, path).collect()
    path = put(tmp_path, [good, good], [("gid", "N", 4, 0)], rows[:1], "rows")
    with pytest.raises(Exception, match="2 records in the index, 1 rows"):
        shapefile.read_shapes(spark, path).collect()
    path = put(tmp_path, [good, good], [("gid", "N", 4, 0)], rows, "cut")
    whole = (tmp_path / "cut.shp").read_bytes()
    (tmp_path / "cut.shp").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends at byte"):
        shapefile.read_shapes(spark, path).collect()
    (tmp_path / "cut.shp").write_bytes(b"GIF89a" + whole[6:])
    with pytest.raises(Exception, match="not a shapefile"):
        shapefile.read_shapes(spark, path).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no .shp file"):
        shapefile.read_shapes(spark, str(tmp_path / "empty")).collect()


def test_written_bounds(tmp_path):
    files = shapefile.polygon_files([(7, None, [np.array(SQUARE)])])
    assert struct.unpack_from("<4d", files[".shp"], 36) == (0, 0, 1, 1)
    assert struct.unpack_from(">i", files[".shp"], 24)[0] * 2 == len(files[".shp"])


def test_small_splits_are_bounded(spark, tmp_path, monkeypatch):
    v = spark.range(400).selectExpr("id as gid", "'n' as name", "0 as ring",
                                    "explode(sequence(0, 3)) as pos").selectExpr("*", "cast(pos % 2 as double) as x", "cast(pos div 2 as double) as y")
    shapefile.write_boundary_shapes(v, str(tmp_path))
    every = shapefile.read_shapes(spark, str(tmp_path), ["gid"], split_bytes=64).collect()
    monkeypatch.setattr(shapefile, "SLICES", 8)
    reader = shapefile.ShapefileReader(str(tmp_path), shapefile.T.StructType(shapefile.SHAPE), [], "utf-8", 64)
    assert 8 <= len(reader.partitions()) <= 10
    assert sum(p.last - p.first for p in reader.partitions()) == 400 == len({r.gid for r in every})
