"""Shapefile and GeoPackage layers, decoded from their bytes on the executors.

Spark lists the files. A shapefile is read in pieces: one pass over its records' heads finds them, and a piece reads its rows
of the .dbf, which have a fixed length. A GeoPackage is copied to the disk of one task, which reads it row by row.
Coordinates have to be degrees.
"""

from __future__ import annotations

import json
import shutil
import struct
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import InputError
from .geojson import BLOCK, PIECE, in_pieces, open_path
from .readers import geojson_geometry, geojson_lines

Ring = list[list[float]]


def _area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _polygons(rings: list[Ring]) -> list[list[Ring]]:
    """Shapefile rings to polygons: a clockwise ring opens a polygon, others are holes of the one before."""
    out: list[list[Ring]] = []
    for ring in rings:
        if not out or _area(ring) <= 0:
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


def cut_shp(source, size: int, split: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """Ranges of some ``split`` bytes of a .shp file's records: begin, end and the number of records before."""
    begin = at = 100
    first = n = base = 0
    block = b""
    while at + 12 <= size:
        if at + 8 > base + len(block):
            source.seek(at)
            base, block = at, source.read(BLOCK)
        at += 8 + 2 * struct.unpack_from(">i", block, at + 4 - base)[0]
        n += 1
        if at - begin >= split or at + 12 > size:
            yield begin, min(at, size), first
            begin, first = at, n


def read_shp(data: bytes, at: int = 100) -> Iterator[dict | None]:
    """GeoJSON geometries of the records of a .shp file (or of a piece, at 0): polygons, lines and points, with or without Z
    and M."""
    while at + 12 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0] % 10
        body = at + 12
        if kind == 1:
            yield {"type": "Point", "coordinates": list(struct.unpack_from("<2d", data, body))}
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 40 + 4 * parts)
            rings = [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            yield {"type": "MultiPolygon", "coordinates": _polygons(rings)} if kind == 5 else {"type": "MultiLineString", "coordinates": rings}
        else:
            yield None
        at += 8 + 2 * words


def read_dbf(source, first: int = 0) -> Iterator[dict[str, str | None]]:
    """Records of a .dbf file from one on, as text."""
    count, head, size = struct.unpack_from("<IHH", source.read(32), 4)
    source.seek(0)
    data, fields, at = source.read(head), [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    some = max(1, BLOCK // max(size, 1))
    for k in range(first, count, some):
        source.seek(head + k * size)
        data = source.read(min(some, count - k) * size)
        for p in range(1, min(some, count - k) * size, size):
            row = {}
            for name, width in fields:
                text = data[p : p + width].decode("utf-8", "replace").strip(" \0")
                row[name], p = text or None, p + width
            yield row


def read_wkb(data: bytes, at: int = 0) -> tuple[dict | None, int]:
    """A GeoJSON geometry from WKB, and where it ends; heights and measures are dropped."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(f"{order}I", data, at + 1)[0]
    extra = bool(code & 0x80000000) + bool(code & 0x40000000) + (code % 10000 // 1000 in (1, 2)) + 2 * (code % 10000 // 1000 == 3)
    kind, at, width = (code & 0xFFFF) % 1000, at + 5, 2 + extra

    def points(at: int) -> tuple[Ring, int]:
        n = struct.unpack_from(f"{order}I", data, at)[0]
        flat = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
        return [list(flat[i * width : i * width + 2]) for i in range(n)], at + 4 + 8 * n * width

    if kind == 1:
        return {"type": "Point", "coordinates": list(struct.unpack_from(f"{order}2d", data, at))}, at + 8 * width
    if kind == 2:
        line, at = points(at)
        return {"type": "LineString", "coordinates": line}, at
    n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
    parts = []
    for _ in range(n):
        part, at = points(at) if kind == 3 else read_wkb(data, at)
        parts.append(part if kind == 3 else part and part["coordinates"])
    name = {3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}.get(kind)
    return ({"type": name, "coordinates": parts} if name else None), at


def read_gpkg(path: str, layer: str | None = None) -> Iterator[tuple[dict | None, dict]]:
    """Geometries and attributes of a GeoPackage layer (the first one, if none is named) in a local file."""
    import sqlite3

    db = sqlite3.connect(path)
    layers = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
    for table, column in layers:
        if layer in (None, table):
            found = db.execute(f'SELECT * FROM "{table}"')
            names = [x[0] for x in found.description]
            for row in found:
                values = dict(zip(names, row, strict=True))
                blob = values.pop(column)
                skip = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
                yield (read_wkb(blob, skip)[0] if blob else None), {
                    k: None if v is None else str(v) for k, v in values.items() if not isinstance(v, bytes)
                }
            return


def _rows(geometries: DataFrame, properties: list[str], lines: bool) -> DataFrame:
    shape = geojson_lines(F.col("feature")) if lines else geojson_geometry(F.col("feature"))
    name = "lines" if lines else "geometry"
    return geometries.select(
        *[F.get_json_object("properties", f"$['{p}']").alias(p) for p in properties], shape.alias(name)
    ).where(F.col(name).isNotNull())


def _pair(geometry: dict, properties: dict) -> tuple[str, str]:
    return json.dumps({"geometry": geometry}), json.dumps(properties)


def read_shapefile(spark: SparkSession, path: str, properties: list[str], lines: bool = False) -> DataFrame:
    """A shapefile (path of the .shp; its .dbf lies beside it), or all of a folder."""
    folder = path[: -len(".shp")] + ".{shp,dbf}" if path.endswith(".shp") else path.rstrip("/") + "/*.{shp,dbf}"
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_replace("path", r"\.\w+$", "").alias("base"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "path"
    )
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path"))).alias(kind)
    pairs = files.groupBy("base").agg(of("shp"), of("dbf")).where("shp is not null").select("shp", "dbf")

    def cut_file(row) -> Iterator[tuple]:
        system, path = open_path(row.shp)
        with system.open_input_file(path) as source:
            for begin, end, first in cut_shp(source, source.size()):
                yield row.shp, row.dbf, begin, end, first

    def read_piece(piece) -> Iterator[tuple]:
        system, path = open_path(piece.shp)
        with system.open_input_file(path) as source:
            source.seek(piece.begin)
            shapes = read_shp(source.read(piece.end - piece.begin), 0)
        with ExitStack() as stack:
            attributes = iter(())
            if isinstance(piece.dbf, str):
                system, path = open_path(piece.dbf)
                attributes = read_dbf(stack.enter_context(system.open_input_file(path)), piece.first)
            for shape in shapes:
                row = next(attributes, {})
                if shape is not None:
                    yield _pair(shape, row)

    schema = "shp string, dbf string, begin long, end long, first long"
    return _rows(in_pieces(pairs, cut_file, schema, read_piece, "feature string, properties string"), properties, lines)


def read_geopackage(spark: SparkSession, path: str, properties: list[str], layer: str | None = None, lines: bool = False) -> DataFrame:
    """A GeoPackage layer."""

    def read_file(row) -> Iterator[tuple]:
        system, path = open_path(row.path)
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as copy:
            with system.open_input_stream(path) as source:
                shutil.copyfileobj(source, copy, 1 << 20)
            copy.flush()
            yield from (_pair(g, p) for g, p in read_gpkg(copy.name, layer) if g is not None)

    files = spark.read.format("binaryFile").load(path).select("path")
    return _rows(in_pieces(files, lambda row: [tuple(row)], "path string", read_file, "feature string, properties string"), properties, lines)


def read_parcels(spark: SparkSession, path: str, type_col: str = "UseType") -> DataFrame:
    """Parcels from GeoJSON, Shapefile or GeoPackage, by the file's name."""
    from .readers import read_geojson

    if path.endswith(".shp"):
        rows = read_shapefile(spark, path, [type_col])
    elif path.endswith(".gpkg"):
        rows = read_geopackage(spark, path, [type_col])
    else:
        rows = read_geojson(spark, path, [type_col])
    if rows.where(F.col(type_col).isNotNull()).isEmpty() and not rows.isEmpty():
        raise InputError(f"parcels: missing column {type_col}")
    return rows
