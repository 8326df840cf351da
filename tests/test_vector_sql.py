"""Shapefile and GeoPackage layers, and SQL functions."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from wayfare.functions import geo, sql, text
from wayfare.functions.contracts import InputError
from wayfare.sources import vector

RING = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def shape(kind, rings):
    points = [p for r in rings for p in r]
    starts, n = [], 0
    for r in rings:
        starts.append(n)
        n += len(r)
    return struct.pack("<i4d2i", kind, 0, 0, 4, 4, len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(
        struct.pack("<2d", *p) for p in points
    )


def shp(records):
    body = b"".join(struct.pack(">2i", k + 1, len(r) // 2) + r for k, r in enumerate(records))
    return b"\0" * 100 + body


def dbf(rows):
    head = struct.pack("<4BIHH20x", 3, 25, 1, 1, len(rows), 32 + 32 + 1, 21) + b"UseType\0\0\0\0C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14 + b"\r"
    return head + b"".join(b" " + r.encode().ljust(20) for r in rows)


def test_shapefile(spark, tmp_path):
    (tmp_path / "p.shp").write_bytes(shp([shape(5, [RING, HOLE]), struct.pack("<i", 0), shape(5, [[(x + 9, y) for x, y in RING]])]))
    (tmp_path / "p.dbf").write_bytes(dbf(["City Park", "none", "Motel"]))
    rows = vector.read_parcels(spark, str(tmp_path / "p.shp"))
    at = lambda x, y: [r.UseType for r in rows.where(geo.inside(F.lit(x), F.lit(y), F.col("geometry"))).collect()]
    assert at(0.5, 0.5) == ["City Park"] and at(1.5, 1.5) == [] and at(9.5, 0.5) == ["Motel"]
    with pytest.raises(InputError):
        vector.read_parcels(spark, str(tmp_path / "p.shp"), "Missing")
    (tmp_path / "r.shp").write_bytes(shp([shape(3, [RING])]))
    assert len(vector.read_shapefile(spark, str(tmp_path / "r.shp"), [], lines=True).first().lines[0]) == 5


def wkb_polygon(rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "p.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('parcels', 'geom')")
    db.execute("CREATE TABLE parcels (fid INTEGER, geom BLOB, UseType TEXT)")
    many = struct.pack("<BII", 1, 6, 1) + wkb_polygon([RING, HOLE])
    db.executemany(
        "INSERT INTO parcels VALUES (?, ?, ?)",
        [(1, b"GP\0\1" + b"\0" * 4 + wkb_polygon([RING]), "Motel"), (2, b"GP\0\3" + b"\0" * 36 + many, None), (3, None, "x")]
    )
    db.commit()
    db.close()
    rows = vector.read_parcels(spark, path)
    assert sorted(r.UseType or "" for r in rows.collect()) == ["", "Motel"]
    assert rows.where(geo.inside(F.lit(1.5), F.lit(1.5), F.col("geometry"))).count() == 1


def test_wkb_kinds():
    point = struct.pack(">BI2d", 0, 1, 1.0, 2.0)
    assert vector.read_wkb(point) == ({"type": "Point", "coordinates": [1.0, 2.0]}, 21)
    line = struct.pack("<BII6d", 1, 1002, 2, 0, 0, 5, 1, 1, 5)  # with heights
    assert vector.read_wkb(line)[0] == {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.0]]}


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    df = spark.createDataFrame([(34.05, -118.25, "Parking"), (-89.0, 10.0, None), (None, None, "zoo")], "y double, x double, w string")
    found = df.select(
        F.expr("haversine_m(34.0, -118.0, y, x)"), geo.haversine_m(
            F.lit(34.0), F.lit(-118.0), F.col("y"), F.col("x")
        ), F.expr("mercator_x(x)"), geo.mercator_x(F.col("x")),
        F.expr("mercator_y(y)"), geo.mercator_y(F.col("y")), F.expr("land_use(w)"), text.standardize_type(F.col("w")),
    ).collect()
    for r in found:
        for a, b in zip(r[::2], r[1::2], strict=True):
            assert a == b or a == pytest.approx(b)
    assert spark.sql(
        "SELECT in_night(23, 20, 7), in_night(8, 20, 7), hours_between(TIMESTAMP'2025-01-01 00:00:00', TIMESTAMP'2025-01-01 01:30:00')"
    ).first()[:] == (True, False, 1.5)


def test_shapefile_in_pieces(spark, tmp_path, monkeypatch):
    import io

    rings = [[(x + k, y) for x, y in RING] for k in range(50)]
    data, table = shp([shape(5, [r]) if k % 9 else struct.pack("<i", 0) for k, r in enumerate(rings)]), dbf([f"type {k}" for k in range(50)])
    monkeypatch.setattr(vector, "BLOCK", 64)
    whole = list(vector.read_shp(data))
    for split in (1, 500, 10**9):
        pieces = list(vector.cut_shp(io.BytesIO(data), len(data), split))
        found = [(g, row["UseType"]) for a, b, first in pieces for g, row in zip(vector.read_shp(data[a:b], 0), vector.read_dbf(io.BytesIO(table), first), strict=False)]
        assert found == [(g, f"type {k}") for k, g in enumerate(whole)] and len(pieces) == {1: 50, 500: len(pieces), 10**9: 1}[split]


def test_files_are_written_as_rows_come(tmp_path):
    import io

    import pandas as pd

    from wayfare.plans import files

    made, open_now = {}, []

    def out(kind):
        made[kind] = io.BytesIO()
        made[kind].close = lambda: None
        return made[kind]

    def tables():
        for k in range(5):
            open_now.append(sum(len(f.getvalue()) for f in made.values()))
            yield pd.DataFrame({"UseType": [f"t{k}"] * 40, "xmin": 0.0 + k, "ymin": 0.0, "xmax": 1.0 + k, "ymax": 1.0})

    files.geojson(tables(), out)
    assert open_now[-1] > 3 * open_now[1] > 0  # before the last rows came, the first ones were written
    open_now.clear()
    made.clear()
    files.shapefile(tables(), out)
    assert open_now[-1] > 3 * open_now[1] > 0
    rows = list(vector.read_dbf(io.BytesIO(made["dbf"].getvalue())))
    assert [r["UseType"] for r in rows] == [f"t{k}" for k in range(5) for _ in range(40)] and len(list(vector.read_shp(made["shp"].getvalue()))) == 200
