"""Vector files of given tables, written by tasks: what the readers of Shapefile, GeoPackage and GeoJSON are tried on."""

from __future__ import annotations

import json
import shutil
import struct
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship
from ..sources.geojson import open_path

BOX = ["xmin", "ymin", "xmax", "ymax"]
#: Opens the file of a kind.
Out = Callable[[str], BinaryIO]


def _ring(row) -> list[tuple[float, float]]:
    return [(row.xmin, row.ymin), (row.xmin, row.ymax), (row.xmax, row.ymax), (row.xmax, row.ymin), (row.xmin, row.ymin)]


def shapefile(tables: Iterator[pd.DataFrame], out: Out) -> None:
    """Rectangles with a type: a .shp and its .dbf, whose head counts the rows."""
    n = 0
    with out("shp") as shapes, tempfile.TemporaryFile() as table:
        shapes.write(b"\0" * 100)
        for rows in tables:
            body, types = [], []
            for row in rows.itertuples(index=False):
                n += 1
                record = struct.pack("<i4d3i", 5, row.xmin, row.ymin, row.xmax, row.ymax, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in _ring(row))
                body.append(struct.pack(">2i", n, len(record) // 2) + record)
                types.append(b" " + row.UseType.encode().ljust(40))
            shapes.write(b"".join(body))
            table.write(b"".join(types))
        table.seek(0)
        with out("dbf") as attributes:
            attributes.write(struct.pack("<4BIHH20x", 3, 25, 1, 1, n, 32 + 32 + 1, 41) + b"UseType\0\0\0\0C" + b"\0" * 4 + bytes([40, 0]) + b"\0" * 14 + b"\r")
            shutil.copyfileobj(table, attributes, 1 << 20)


def geopackage(tables: Iterator[pd.DataFrame], out: Out) -> None:
    """The same as a layer of a GeoPackage."""
    import sqlite3

    with tempfile.TemporaryDirectory() as folder:
        db = sqlite3.connect(f"{folder}/x.gpkg")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('parcels', 'geom')")
        db.execute("CREATE TABLE parcels (geom BLOB, UseType TEXT)")
        for rows in tables:
            for row in rows.itertuples(index=False):
                ring = b"".join(struct.pack("<2d", *p) for p in _ring(row))
                db.execute("INSERT INTO parcels VALUES (?, ?)", (b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIII", 1, 3, 1, 5) + ring, row.UseType))
        db.commit()
        db.close()
        with open(f"{folder}/x.gpkg", "rb") as made, out("gpkg") as layer:
            shutil.copyfileobj(made, layer, 1 << 20)


def geojson(tables: Iterator[pd.DataFrame], out: Out) -> None:
    """The same as one feature collection; other columns are properties."""
    with out("geojson") as collection:
        collection.write(b'{"type": "FeatureCollection", "features": [')
        for k, rows in enumerate(tables):
            features = [
                {"type": "Feature", "properties": {k: v for k, v in r._asdict().items() if k not in BOX}, "geometry": {"type": "Polygon", "coordinates": [_ring(r)]}}
                for r in rows.itertuples(index=False)
            ]
            collection.write((", " if k else "").encode() + json.dumps(features)[1:-1].encode())
        collection.write(b"]}")


def write_files(rows: DataFrame, folder: str, write: Callable[[Iterator[pd.DataFrame], Out], None], files: int, by: str) -> int:
    """Writes rows, dealt by a column, as some files ``part-<k>.<kind>``; returns how many. A file is one task's rows, written
    as they come."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        some = (b for b in batches if len(b))
        first = next(some, None)
        if first is not None:
            system, path = open_path(folder)
            system.create_dir(path, recursive=True)
            write(chain([first], some), lambda kind: system.open_output_stream(f"{path}/part-{TaskContext.get().partitionId()}.{kind}"))
        yield pd.DataFrame({"n": [int(first is not None)]})

    return rows.repartition(files, by).mapInPandas(run, "n int").groupBy().sum("n").first()[0]
