"""Shapefiles: a data source that splits a file by its index, and a sink.

Every task reads its own slice of the ``.shx``, the bytes of its records in the ``.shp`` and its rows of the ``.dbf``;
the driver reads headers only.  Files are opened by pyarrow, so local paths and the remote ones it knows both work.
"""

from __future__ import annotations

import datetime
import math
import os
import struct
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of shapes that a task reads in all, and at once.
SPLIT_BYTES = 32 << 20
READ_BYTES = 8 << 20
#: Vertices that one written file holds, about.
FILE_VERTICES = 200_000
#: A smaller ``split_bytes`` makes no more slices than this, besides one per file, while they stay below SPLIT_BYTES.
SLICES = 512
# Fixed values of the format.
FILE_CODE, VERSION, HEADER = 9994, 1000, 100
NULL_SHAPE, POLYGON = 0, 5
POINTS, MULTI_POINTS, WITH_PARTS = (1, 11, 21), (8, 18, 28), (3, 5, 13, 15, 23, 25)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SHAPE = [T.StructField("_record", T.LongType()), T.StructField("_shape", T.IntegerType()),
         T.StructField("_parts", T.ArrayType(T.ArrayType(POINT)))]


def _open(path: str):
    """(file system, path within it) of a URI or a local path."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _read(path: str, start: int, size: int) -> bytes:
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        got = f.read_at(size, start)
    if len(got) < size:
        raise ValueError(f"{path}: ends at byte {start + len(got)}, {start + size} expected")
    return got


def _size(path: str) -> int:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def _files(path: str) -> list[str]:
    """The ``.shp`` files that a path names: one file, or all in a folder and below."""
    system, inner = _open(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    below = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(path.rstrip("/") + i.path[len(inner.rstrip("/")):] for i in below if i.path.lower().endswith(".shp"))


def _beside(path: str, ending: str) -> str:
    return path[:-4] + (ending.upper() if path.endswith(".SHP") else ending)


@dataclass(frozen=True)
class Attribute:
    """A column of the ``.dbf``: where it stands in a row and how it is read."""

    name: str
    kind: str
    start: int
    length: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            whole = self.kind == "N" and not self.decimals and self.length <= 18
            return T.LongType() if whole else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        text = raw[self.start:self.start + self.length].decode(encoding).strip("\x00").rstrip()
        if self.kind in "NFDL":
            text = text.strip()
            if not text or set(text) <= {"*", "?"} or (self.kind == "D" and set(text) == {"0"}):
                return None
            if self.kind == "L":
                return text in "YyTt"
            if self.kind == "D":
                return datetime.datetime.strptime(text, "%Y%m%d").date()
            return int(text) if isinstance(self.type, T.LongType) else float(text)
        return text


def _attributes(path: str, encoding: str) -> tuple[int, int, int, list[Attribute]]:
    """Rows, bytes of the header, bytes of a row, and the columns of a ``.dbf``."""
    rows, head, width = struct.unpack("<IHH", _read(path, 4, 8))
    block = _read(path, 32, head - 32)
    out, start = [], 1
    for at in range(0, len(block) - 31, 32):
        if block[at] == 0x0D:
            break
        name = block[at:at + 11].split(b"\x00")[0].decode(encoding)
        kind, length, decimals = chr(block[at + 11]), block[at + 16], block[at + 17]
        out.append(Attribute(name, kind, start, length, decimals))
        start += length
    if start != width:
        raise ValueError(f"{path}: columns take {start} bytes of a row, the header says {width}")
    return rows, head, width, out


def _parts(body: bytes, where: str) -> tuple[int, list | None]:
    """Kind and vertex lists of one record; NULL for a null shape."""
    def need(size):
        if len(body) < size:
            raise ValueError(f"{where}: {len(body)} bytes, {size} needed")

    def points(start, n):
        need(start + 16 * n)
        return np.frombuffer(body, "<f8", 2 * n, start).reshape(n, 2)

    need(4)
    kind = struct.unpack_from("<i", body)[0]
    if kind == NULL_SHAPE:
        return kind, None
    if kind in POINTS:
        return kind, [points(4, 1)]
    if kind in MULTI_POINTS:
        need(40)
        return kind, [points(40, max(struct.unpack_from("<i", body, 36)[0], 0))]
    if kind not in WITH_PARTS:
        raise ValueError(f"{where}: shapes of kind {kind} are not read")
    need(44)
    n, total = struct.unpack_from("<ii", body, 36)
    if n < 0 or total < 0:
        raise ValueError(f"{where}: {n} parts, {total} points")
    need(44 + 4 * n)
    starts = [*struct.unpack_from(f"<{n}i", body, 44), total]
    if n and (starts[0] != 0 or any(a > b for a, b in zip(starts, starts[1:]))):
        raise ValueError(f"{where}: parts do not ascend")
    all_points = points(44 + 4 * n, total)
    return kind, [all_points[a:b] for a, b in zip(starts, starts[1:])]


@dataclass
class Slice(InputPartition):
    """Records ``first`` to ``last`` (exclusive) of one file."""

    path: str
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, wanted: list[str], encoding: str, split: int):
        self.path, self.schema, self.wanted, self.encoding, self.split = path, schema, wanted, encoding, split

    def partitions(self) -> list[Slice]:
        out, files = [], _files(self.path)
        split = max(self.split, min(SPLIT_BYTES, sum(map(_size, files)) // SLICES))
        for path in files:
            code, version = struct.unpack(">i", _read(path, 0, 4))[0], struct.unpack("<i", _read(path, 28, 4))[0]
            if (code, version) != (FILE_CODE, VERSION):
                raise ValueError(f"{path}: not a shapefile")
            index = _size(_beside(path, ".shx")) - HEADER
            rows = _attributes(_beside(path, ".dbf"), self.encoding)[0]
            if index < 0 or index % 8 or index // 8 != rows:
                raise ValueError(f"{path}: {index / 8:g} records in the index, {rows} rows of attributes")
            step = max(math.ceil(rows * split / max(_size(path), 1)), 1)
            out += [Slice(path, a, min(a + step, rows)) for a in range(0, rows, step)]
        return out or [Slice("", 0, 0)]

    def _records(self, part: Slice):
        """(record number, bytes) of a slice, neighbours read together."""
        n = part.last - part.first
        index = np.frombuffer(_read(_beside(part.path, ".shx"), HEADER + 8 * part.first, 8 * n), ">i4").reshape(n, 2)
        starts, sizes = index[:, 0].astype(np.int64) * 2, index[:, 1].astype(np.int64) * 2 + 8
        at = 0
        while at < n:
            end = at + 1
            while end < n and starts[end] == starts[end - 1] + sizes[end - 1] and starts[end] + sizes[end] - starts[at] <= READ_BYTES:
                end += 1
            if starts[at] < HEADER or (sizes[at:end] < 12).any():
                raise ValueError(f"{part.path}: index entry {part.first + at} names byte {starts[at]}")
            data = _read(part.path, int(starts[at]), int(starts[end - 1] + sizes[end - 1] - starts[at]))
            for k in range(at, end):
                a = int(starts[k] - starts[at])
                where = f"{part.path}: record at byte {starts[k]}"
                length = struct.unpack_from(">i", data, a + 4)[0]
                if length * 2 + 8 != sizes[k]:
                    raise ValueError(f"{where}: length {length} words, the index says {(sizes[k] - 8) // 2}")
                yield part.first + k, where, data[a + 8:a + int(sizes[k])]
            at = end

    def read(self, partition: Slice):
        schema = to_arrow_schema(self.schema)
        if partition.first >= partition.last:
            return
        table = _beside(partition.path, ".dbf")
        _, head, width, columns = _attributes(table, self.encoding)
        known = {c.name: c for c in columns}
        lost = [w for w in self.wanted if w not in known]
        if lost:
            raise ValueError(f"{table}: no column {', '.join(lost)}")
        rows = _read(table, head + width * partition.first, width * (partition.last - partition.first))
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*held), schema)], schema=schema)

        for record, where, body in self._records(partition):
            raw = rows[width * (record - partition.first):width * (record - partition.first + 1)]
            if raw[:1] == b"*":
                continue
            kind, parts = _parts(body, where)
            points = None if parts is None else [[{"x": x, "y": y} for x, y in p.tolist()] for p in parts]
            held.append((record, kind, points, *(known[w].value(raw, self.encoding) for w in self.wanted)))
            size += len(body)
            if size > READ_BYTES or len(held) >= 2048:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile")``: a row per record, with the columns of the ``.dbf`` behind the shape.

    Options: ``columns`` (names with commas between: only these are read), ``encoding`` (else that of the ``.cpg``,
    else ISO 8859-1) and ``split_bytes``, which is raised where it would make far more than ``SLICES`` slices.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _encoding(self) -> str:
        if self.options.get("encoding"):
            return self.options["encoding"]
        first = (_files(self.options["path"]) or [""])[0]
        try:
            page = _beside(first, ".cpg")
            return _read(page, 0, _size(page)).decode("ascii").strip()
        except FileNotFoundError:
            return "iso-8859-1"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"{self.options['path']}: no .shp file")
        known = {c.name: c for c in _attributes(_beside(files[0], ".dbf"), self._encoding())[3]}
        names = [c.strip() for c in self.options["columns"].split(",") if c.strip()] if "columns" in self.options else list(known)
        lost = [n for n in names if n not in known]
        if lost:
            raise ValueError(f"{files[0]}: no column {', '.join(lost)}")
        return T.StructType([*SHAPE, *(T.StructField(n, known[n].type) for n in names)])

    def reader(self, schema: T.StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], schema, schema.names[3:], self._encoding(),
                               int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_shapes(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Records of a shapefile, or of all in a folder: _record, _shape, _parts and the attributes.

    Rows marked as deleted are left out, a null shape has NULL parts, and M and Z values are passed over.  A broken
    record is an error that names the file and the byte.
    """
    spark.dataSource.register(ShapefileSource)
    reader = spark.read.format("shapefile").options(**options)
    return (reader if columns is None else reader.option("columns", ",".join(columns))).load(path)


def read_boundary_shapes(spark: SparkSession, path: str, id_key: str = "gid", name_key: str = "community", **options) -> DataFrame:
    """Polygon vertices (gid, name, ring, pos, x, y), as ``readers.read_boundaries`` gives them.

    Records of another kind raise; null shapes have no vertices.
    """
    shapes = read_shapes(spark, path, list(dict.fromkeys((id_key, name_key))), **options)
    kind = F.col("_shape")
    rings = F.when(kind.isin(POLYGON, 15, 25, NULL_SHAPE), F.col("_parts")).otherwise(
        F.raise_error(F.concat(F.lit("not a polygon: kind "), kind)).cast(shapes.schema["_parts"].dataType))
    return (shapes.select(F.col(f"`{id_key}`").cast("int").alias("gid"), F.col(f"`{name_key}`").cast("string").alias("name"),
                          F.posexplode(rings).alias("ring", "_ring"))
            .select("gid", "name", "ring", F.posexplode("_ring").alias("pos", "_p"))
            .select("gid", "name", "ring", "pos", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")))


def _head(bounds, words: int) -> bytes:
    return struct.pack(">i20xi", FILE_CODE, words) + struct.pack("<ii8d", VERSION, POLYGON, *bounds, 0, 0, 0, 0)


def polygon_files(records: list[tuple[int, str, list[np.ndarray]]]) -> dict[str, bytes]:
    """The bytes of ``.shp``, ``.shx``, ``.dbf`` and ``.cpg`` of polygons (gid, community, rings)."""
    shapes, index, table, at = [], [], [], HEADER
    for number, (gid, name, rings) in enumerate(records, 1):
        points = np.vstack(rings).astype("<f8")
        starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
        body = (struct.pack("<i4dii", POLYGON, *points.min(axis=0), *points.max(axis=0), len(rings), len(points))
                + starts.tobytes() + points.tobytes())
        shapes.append(struct.pack(">ii", number, len(body) // 2) + body)
        index.append(struct.pack(">ii", at // 2, len(body) // 2))
        at += len(body) + 8
        text = (name or "").encode()
        if len(text) > 254:
            raise ValueError(f"a name of {len(text)} bytes; 254 fit")
        table.append(b" " + str(gid).rjust(18).encode() + text.ljust(254))
    every = np.vstack([p for _, _, rings in records for p in rings])
    bounds = [*every.min(axis=0), *every.max(axis=0)]
    fields = (struct.pack("<11sc4xBB14x", b"gid", b"N", 18, 0) + struct.pack("<11sc4xBB14x", b"community", b"C", 254, 0))
    return {".shp": _head(bounds, at // 2) + b"".join(shapes),
            ".shx": _head(bounds, (HEADER + 8 * len(index)) // 2) + b"".join(index),
            ".dbf": struct.pack("<4BIHH20x", 3, 95, 7, 26, len(table), 32 + len(fields) + 1, 273) + fields + b"\r" + b"".join(table) + b"\x1a",
            ".cpg": b"UTF-8"}


def write_boundary_shapes(vertices: DataFrame, path: str) -> int:
    """Write polygons (gid, name, ring, pos, x, y) as shapefiles of about FILE_VERTICES; the number of files.

    A polygon lies in one file, chosen by its gid, and a task that is run again writes the same file again.
    """
    many = vertices.count() // FILE_VERTICES + 1

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["gid", "ring"]).sort_values(["gid", "ring", "pos"])
        gid, ring, names, points = own["gid"].to_numpy(), own["ring"].to_numpy(), own["name"].to_numpy(), own[["x", "y"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (gid[1:] != gid[:-1]) | (ring[1:] != ring[:-1])))
        records = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(gid)]):
            if not records or records[-1][0] != gid[a]:
                records.append((int(gid[a]), names[a], []))
            records[-1][2].append(points[a:b])
        number = int(pdf["_file"].iloc[0])
        system, inner = _open(path)
        system.create_dir(inner)
        for ending, data in polygon_files(records).items():
            with system.open_output_stream(f"{inner}/part-{number:05d}{ending}") as out:
                out.write(data)
        return pd.DataFrame({"file": [number]})

    parts = vertices.withColumn("_file", F.pmod(F.xxhash64("gid"), F.lit(many))).groupBy("_file").applyInPandas(write, "file long")
    return parts.count()
