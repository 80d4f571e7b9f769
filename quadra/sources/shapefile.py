"""Shapefiles (.shp with .dbf) read and written through Spark's own file access, so that any store it reads will do.

The format keeps a file under 2 GB. A file is one task's; a folder of files is read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra import functions as S
from quadra import runtime
from quadra.functions.native import native

POINT, LINE, POLYGON, MULTI = 1, 3, 5, 8
_GEOMETRY = "kind int, parts array<int>, coords array<double>"


def _fields(header: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type letter, width, decimals) of a dBASE header."""
    out, at = [], 32
    while at < len(header) and header[at] != 0x0D:
        name = header[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(header[at + 11]), header[at + 16], header[at + 17]))
        at += 32
    return out


def _type(letter: str, decimals: int) -> T.DataType:
    if letter in "NF":
        return T.DoubleType() if decimals or letter == "F" else T.LongType()
    return T.BooleanType() if letter == "L" else T.StringType()


def _records(dbf: bytes) -> list[list]:
    fields = _fields(dbf)
    count, head, size = struct.unpack_from("<IHH", dbf, 4)
    out = []
    for k in range(count):
        at = head + k * size + 1
        row = []
        for _, letter, width, decimals in fields:
            raw = dbf[at : at + width].decode("utf-8", "replace").strip()
            at += width
            if letter in "NF":
                value = None if not raw or raw.startswith("*") else (float(raw) if decimals or letter == "F" else int(raw))
            elif letter == "L":
                value = {"T": True, "Y": True, "F": False, "N": False}.get(raw.upper())
            else:
                value = raw
            row.append(value)
        out.append(row)
    return out


def _shapes(shp: bytes) -> Iterator[tuple[int, list[int], list[float]]]:
    """(kind, vertices of each part, x and y in turn); kind 0 has none."""
    at = 100
    while at + 12 <= len(shp):
        words = struct.unpack_from(">i", shp, at + 4)[0]
        (kind,) = struct.unpack_from("<i", shp, at + 8)
        body, at = at + 12, at + 8 + 2 * words
        flat = kind % 10
        if kind == 0:
            yield 0, [], []
        elif flat == POINT:
            yield POINT, [1], list(struct.unpack_from("<2d", shp, body))
        elif flat == MULTI:
            (n,) = struct.unpack_from("<i", shp, body + 32)
            yield MULTI, [n], np.frombuffer(shp, "<f8", 2 * n, body + 36).tolist()
        else:
            parts, n = struct.unpack_from("<2i", shp, body + 32)
            first = [*struct.unpack_from(f"<{parts}i", shp, body + 40), n]
            yield flat, [b - a for a, b in zip(first, first[1:], strict=False)], np.frombuffer(shp, "<f8", 2 * n, body + 40 + 4 * parts).tolist()


def _parse(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shp, dbf in zip(batch.column("shp").to_pylist(), batch.column("dbf").to_pylist(), strict=True):
            shapes, rows = list(_shapes(shp)), _records(dbf)
            for a in range(0, len(shapes), 4096):
                kinds, parts, coords = zip(*shapes[a : a + 4096], strict=True)
                columns = list(zip(*rows[a : a + 4096], strict=True)) if names else []
                kinds_of = [_type(letter, decimals) for _, letter, _, decimals in _fields(dbf)]
                arrow = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}
                typed = [pa.array(c, arrow[type(k)]) for c, k in zip(columns, kinds_of, strict=True)]
                yield pa.record_batch([*typed, pa.array(kinds, pa.int32()), pa.array(parts, pa.list_(pa.int32())), pa.array(coords, pa.list_(pa.float64()))], names=[*names, "kind", "parts", "coords"])


def read_shapefile(spark: SparkSession, path: str, geom: str = "geom") -> DataFrame:
    """The attributes of all shapefiles under a path, and the geometry as WKB; null shapes are null."""
    runtime.ship(spark)
    load = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path).select(F.regexp_replace("path", rf"\.{ext}$", "").alias("base"), F.col("content").alias(ext))
    dbf = load("dbf")
    header = dbf.select(F.substring("dbf", 1, 32 * 256)).first()
    if header is None:
        raise ValueError(f"no .dbf under {path}")
    fields = _fields(bytes(header[0]))
    schema = T.StructType([T.StructField(n, _type(letter, d)) for n, letter, _, d in fields])
    names = [f.name for f in schema]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), _GEOMETRY])
    rows = load("shp").join(dbf, "base").select("shp", "dbf").mapInArrow(partial(_parse, names=names), ddl)
    zero = F.lit(0.0)
    shape = F.struct(zero.alias("xmin"), zero.alias("ymin"), zero.alias("xmax"), zero.alias("ymax"), F.col("parts"), F.col("coords"))
    xy = F.struct(F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))
    shaped = F.when(F.col("kind") == POINT, S.gdb_point(xy)).when(F.col("kind") == LINE, S.gdb_polyline(shape)).when(F.col("kind") == POLYGON, S.gdb_polygon(shape)).when(F.col("kind") == MULTI, S.gdb_multipoint2(shape))
    return rows.select(*names, shaped.alias(geom))


def _wkb(b: bytes) -> tuple[int, list[list[tuple[float, float]]]]:
    """(kind, parts) of a WKB value."""
    order = "<" if b[0] == 1 else ">"

    def head(at):
        (kind,) = struct.unpack_from(order + "I", b, at + 1)
        z = bool(kind & 0x80000000) + bool(kind & 0x40000000)
        return kind & 0xFF, 2 + z, at + 5

    def read(at, width, n):
        return [struct.unpack_from(order + "dd", b, at + 8 * width * k) for k in range(n)], at + 8 * width * n

    def count(at):
        return struct.unpack_from(order + "I", b, at)[0], at + 4

    def one(at):
        kind, width, at = head(at)
        if kind == 1:
            points, at = read(at, width, 1)
            return kind, [points], at
        n, at = count(at)
        if kind == 2:
            points, at = read(at, width, n)
            return kind, [points], at
        parts = []
        for _ in range(n):
            if kind == 3:
                m, at = count(at)
                points, at = read(at, width, m)
                parts.append(points)
            else:
                _, more, at = one(at)
                parts += more
        return kind, parts, at

    kind, parts, _ = one(0)
    family = {1: POINT, 2: LINE, 3: POLYGON, 4: MULTI, 5: LINE, 6: POLYGON}.get(kind)
    if family is None:
        raise ValueError(f"a shapefile cannot hold WKB kind {kind}")
    return family, parts


def _area(ring) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False)) / 2


def _shape_bytes(wkb: bytes) -> tuple[int, bytes, tuple]:
    kind, parts = _wkb(wkb)
    points = [p for part in parts for p in part]
    xs, ys = zip(*points, strict=True)
    box = (min(xs), min(ys), max(xs), max(ys))
    if kind == POINT:
        return kind, struct.pack("<i2d", kind, *points[0]), box
    flat = struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
    if kind == MULTI:
        return kind, struct.pack("<i4di", kind, *box, len(points)) + flat, box
    first = [sum(map(len, parts[:k])) for k in range(len(parts))]
    return kind, struct.pack(f"<i4d2i{len(parts)}i", kind, *box, len(parts), len(points), *first) + flat, box


def _encode(key, table: pa.Table, names: list[str], types: list[str], geom: str) -> pa.Table:
    """One file set: name, .shp, .shx and .dbf bytes."""
    body, index, kind, boxes, at = [], [], 0, [], 50
    for k, wkb in enumerate(table.column(geom).to_pylist()):
        if wkb is None:
            raw = struct.pack("<i", 0)
        else:
            kind, raw, box = _shape_bytes(wkb)
            boxes.append(box)
        body.append(struct.pack(">2i", k + 1, len(raw) // 2) + raw)
        index.append(struct.pack(">2i", at, len(raw) // 2))
        at += 4 + len(raw) // 2
    bounds = [f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))] if boxes else [0.0] * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *bounds, 0, 0, 0, 0)
    shp, shx = head(at) + b"".join(body), head(50 + 4 * len(index)) + b"".join(index)
    columns = [table.column(n).to_pylist() for n in names]
    fields, cells = [], []
    for name, kind_of, values in zip(names, types, columns, strict=True):
        if kind_of in ("bigint", "int", "smallint", "tinyint"):
            fields.append((name, b"N", 20, 0))
            cells.append([b" " * 20 if v is None else str(v).rjust(20).encode() for v in values])
        elif kind_of in ("double", "float"):
            fields.append((name, b"F", 24, 15))
            cells.append([b" " * 24 if v is None else repr(float(v)).rjust(24)[:24].encode() for v in values])
        else:
            raw = [b"" if v is None else str(v).encode()[:254] for v in values]
            width = max([1, *map(len, raw)])
            fields.append((name, b"C", width, 0))
            cells.append([v.ljust(width) for v in raw])
    head_size, size = 33 + 32 * len(fields), 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, table.num_rows, head_size, size)
    for name, letter, width, decimals in fields:
        dbf += struct.pack("<11sc4xBB14x", name.encode("latin-1", "replace")[:10], letter, width, decimals)
    dbf += b"\r" + b"".join(b" " + b"".join(row) for row in zip(*cells, strict=True)) + b"\x1a"
    return pa.table([pa.array([f"part-{key[0].as_py():05d}"]), pa.array([shp], pa.binary()), pa.array([shx], pa.binary()), pa.array([dbf], pa.binary())], names=["name", "shp", "shx", "dbf"])


def write_shapefile(df: DataFrame, path: str, geom: str = "geom", rows_per_file: int = 100_000) -> None:
    """Write df as shapefiles of at most about `rows_per_file` rows each. Files are made and stored by tasks, through Spark's file system."""
    spark = df.sparkSession
    runtime.ship(spark)
    names = [c for c in df.columns if c != geom]
    types = [dict(df.dtypes)[n] for n in names]
    files = max(1, -(-df.count() // rows_per_file))
    encode = partial(_encode, names=names, types=types, geom=geom)
    split = df.withColumn("__file", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    made = split.groupBy("__file").applyInArrow(lambda key, table: encode(key, table), "name string, shp binary, shx binary, dbf binary")
    stored = [native("quadra_store", F.concat(F.lit(f"{path}/"), "name", F.lit(f".{ext}")), F.col(ext)) for ext in ("shp", "shx", "dbf")]
    made.select(sum(stored[1:], stored[0]).alias("bytes")).agg(F.sum("bytes")).collect()
