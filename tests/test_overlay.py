"""Clipping, areas and dissolved shapes against plain geometry."""

import random

import pytest
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.operators import overlay


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def shoelace(points):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(points, points[1:], strict=False)) / 2


def shapes(spark, rows):
    return spark.createDataFrame(rows, f"id long, geometry {geo.GEOMETRY}")


def test_area_and_clip(spark):
    square, hole = ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (1, 2), (2, 2), (2, 1)])
    rows = [(1, [[square, hole]]), (2, [[ring([(-1, 2), (2, 5), (5, 2), (2, -1)])]]), (3, [[ring([(9, 9), (10, 9), (9, 10)])], [square]]), (4, []), (5, [[ring([(3, 0), (6, 0), (6, 3)])]])]
    box = (0.0, 1.5, 3.0, 5.0)
    df = shapes(spark, rows).withColumn("c", overlay.clip(F.col("geometry"), box))
    found = {r.id: (round(r.a, 9), round(r.b, 9), r.n) for r in df.select("id", overlay.area(F.col("geometry")).alias("a"), overlay.area(F.col("c")).alias("b"), F.size("c").alias("n")).collect()}
    # The diamond's part: a strip of 3 by 2 above y = 2, less its two corners, and the strip from 1.5 to 2.
    diamond = sum((min(3.0, 2 + h) - max(0.0, 2 - h)) / 1000 for h in [3 - abs(2 - (1.5 + (k + 0.5) / 1000)) for k in range(3500)] if h > 0)
    assert found[1] == (15.0, 7.0, 1) and found[3] == (16.5, 7.5, 1) and found[4] == (0.0, 0.0, 0) and found[5] == (4.5, 0.0, 0)
    assert found[2][0] == 18.0 and found[2][1] == pytest.approx(diamond, abs=1e-3)
    assert sorted(r.id for r in overlay.in_box(shapes(spark, rows), box).collect()) == [1, 2, 3]


def test_dissolved_cells_have_their_area_and_border(spark):
    r = random.Random(6)
    cells = {(r.randint(0, 9), r.randint(0, 9), r.choice("ab")) for _ in range(160)}
    rows = []
    for i, j, key in sorted(cells):
        points = [(i / 10, j / 10), ((i + 1) / 10, j / 10), ((i + 1) / 10, (j + 1) / 10), (i / 10, (j + 1) / 10)]
        rows.append((key, [[ring(points if r.random() < 0.5 else points[::-1])]]))  # either direction
    df = spark.createDataFrame([*rows, (None, rows[0][1]), ("c", [[ring([(0, 0), (3, 0), (3, 3), (0, 3)]), ring([(1, 1), (2, 1), (2, 2), (1, 2)])], [ring([(1, 1), (2, 1), (2, 2), (1, 2)])]])], f"key string, geometry {geo.GEOMETRY}")
    found = {x.key: x.geometry for x in overlay.dissolve(df, "key").collect()}
    assert set(found) == {"a", "b", "c"} and len(found["c"][0]) == 1  # the second area fills the hole
    for key in "ab":
        own = {(i, j) for i, j, k in cells if k == key}
        border = sum((i + di, j + dj) not in own for i, j in own for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        (rings,) = found[key]
        assert sum(map(shoelace, rings)) == pytest.approx(len(own) / 100) and sum(len(x) - 1 for x in rings) == border
        assert all(x[0] == x[-1] for x in rings)
    places = spark.createDataFrame([(i / 10 + 0.05, j / 10 + 0.05) for i in range(10) for j in range(10)], "x double, y double")
    inside = overlay.dissolve(df, "key").where("key = 'a'").crossJoin(places).where(geo.inside(F.col("x"), F.col("y"), F.col("geometry")))
    assert inside.count() == sum(k == "a" for _, _, k in cells)
    assert overlay.dissolve(df.limit(0), "key").collect() == []


def test_symmetric_difference(spark):
    square, hole = ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (2, 1), (2, 2), (1, 2)])
    pairs = [([[square, hole]], [[ring([(1.5, 1.5), (6, 1.5), (6, 3), (1.5, 3)])]]), ([[square]], [[square]]), ([[square]], None), ([], [[hole], [ring([(5, 5), (6, 5), (6, 6)])]])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"id long, a {geo.GEOMETRY}, b {geo.GEOMETRY}")
    places = spark.createDataFrame([(i / 4 + 0.1, j / 4 + 0.07) for i in range(28) for j in range(28)], "x double, y double")
    inside = lambda g: F.coalesce(geo.inside(F.col("x"), F.col("y"), g), F.lit(False))
    rows = df.crossJoin(places).withColumn("c", overlay.symmetric_difference(F.col("a"), F.col("b")))
    assert rows.where(inside(F.col("c")) != (inside(F.col("a")) != inside(F.col("b")))).count() == 0
    assert rows.where(inside(F.col("c"))).count() > 100 and rows.where("id = 1").where(inside(F.col("c"))).count() == 0
