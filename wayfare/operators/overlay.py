"""Map layers of areas: clipping to a box, area, and dissolving the areas of a group into one shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import GEOMETRY, let
from ..shipping import ship
from .spatial import ring_edges

POINT = "struct<x:double,y:double>"


def ring_area(ring: Column) -> Column:
    """The signed area of a ring: positive if it runs counter-clockwise. Measured from its first point, so that small rings
    far from the origin keep their digits."""
    o = F.element_at(ring, 1)
    cross = lambda e: (e["ax"] - o["x"]) * (e["by"] - o["y"]) - (e["bx"] - o["x"]) * (e["ay"] - o["y"])
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + cross(e)) / 2


def area(geometry: Column) -> Column:
    """Area of a geometry: the first ring of each polygon less the others."""
    size = lambda ring: F.abs(ring_area(ring))
    polygon = lambda p: F.coalesce(size(F.get(p, 0)), F.lit(0.0)) * 2 - F.aggregate(p, F.lit(0.0), lambda s, r: s + size(r))
    return F.aggregate(geometry, F.lit(0.0), lambda s, p: s + polygon(p))


def _cut(axis: str, limit: float, above: bool) -> tuple:
    """Steps (for ``let``) from a closed ring to its part on one side of a line; points on the line stay, an edge that crosses
    it gives a point on it."""
    other = "y" if axis == "x" else "x"
    stays = lambda v: v >= limit if above else v <= limit

    def of(e: Column) -> Column:
        a, b = (F.struct(e[f"{k}x"].alias("x"), e[f"{k}y"].alias("y")) for k in "ab")
        t = (F.lit(limit) - e[f"a{axis}"]) / (e[f"b{axis}"] - e[f"a{axis}"])
        met = {axis: F.lit(limit), other: e[f"a{other}"] + t * (e[f"b{other}"] - e[f"a{other}"])}
        point = F.struct(met["x"].alias("x"), met["y"].alias("y"))
        keep_a, keep_b = stays(a[axis]), stays(b[axis])
        return F.when(keep_a & keep_b, F.array(b)).when(keep_b, F.array(point, b)).when(keep_a, F.array(point)).otherwise(F.array().cast(f"array<{POINT}>"))

    closed = lambda points: F.when(F.size(points) > 0, F.concat(F.slice(points, -1, 1), points)).otherwise(points)
    return lambda ring: F.flatten(F.transform(ring_edges(ring), of)), closed


def clip(geometry: Column, box: tuple[float, float, float, float]) -> Column:
    """A geometry's part in a box (xmin, ymin, xmax, ymax). Rings are cut by the four sides in turn: parts of a ring that the
    box separates stay joined along its border, which changes no area. Rings outside are gone; a polygon whose first ring is
    gone, too."""
    x1, y1, x2, y2 = box
    steps = [*_cut("x", x1, True), *_cut("x", x2, False), *_cut("y", y1, True), *_cut("y", y2, False)]
    polygon = lambda p: F.transform(p, lambda ring: let(ring, *steps))
    whole = F.filter(F.transform(geometry, polygon), lambda p: F.size(F.get(p, 0)) > 3)
    return F.transform(whole, lambda p: F.filter(p, lambda r: F.size(r) > 3))


def symmetric_difference(a: Column, b: Column) -> Column:
    """What lies in exactly one of two geometries, as one polygon whose rings count even-odd: a point is in it if the rings of
    both around it are odd in number. Polygons of one geometry must not overlap each other. Edges that both have cancel in
    every test of a point; rings are not split where they cross, so ``area`` does not hold for it."""
    rings = lambda g: F.coalesce(F.flatten(g), F.array().cast(f"array<array<{POINT}>>"))
    return F.array(F.concat(rings(a), rings(b)))


def in_box(shapes: DataFrame, box: tuple[float, float, float, float], geometry: str = "geometry") -> DataFrame:
    """The shapes of which something lies in a box, whole."""
    return shapes.where(F.size(clip(F.col(geometry), box)) > 0)


def dissolve(shapes: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """One shape for each value of ``key`` (null left out): edges that two areas share cancel, what is left is stitched to
    rings. Neighbours must share the vertices of their border, as the tracts of a census do, and areas of a group must not
    overlap. The shape is one polygon whose rings count even-odd. A task stitches the outer border of a group only."""
    rings = shapes.where(F.col(key).isNotNull()).select(key, F.explode(geometry).alias("p")).select(key, F.posexplode("p").alias("k", "ring"))
    # Outer rings counter-clockwise, holes clockwise: shared edges then run against each other.
    forward = (ring_area(F.col("ring")) > 0) == (F.col("k") == 0)
    rings = rings.select(key, F.when(forward, F.col("ring")).otherwise(F.reverse("ring")).alias("ring"))
    edges = rings.select(key, F.explode(ring_edges(F.col("ring"))).alias("e")).where("e.ax <> e.bx or e.ay <> e.by").select(key, "e.*")
    a, b = (F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "ab")
    found = edges.groupBy(key, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("ax", "ay", "bx", "by"), F.struct("ax", "ay")).alias("e")
    )
    border = found.where("n % 2 = 1").select(key, "e.*")
    kind = shapes.schema[key].dataType.simpleString()

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[tuple, list[tuple]] = {}
        for ax, ay, bx, by in sorted(rows[["ax", "ay", "bx", "by"]].itertuples(index=False, name=None)):
            ahead.setdefault((ax, ay), []).append((bx, by))
        out = []
        for start in sorted(ahead):
            while ahead[start]:
                ring, at = [start], start
                while ahead.get(at):
                    at = ahead[at].pop()
                    ring.append(at)
                    if at == start:
                        break
                out.append([{"x": x, "y": y} for x, y in ring])
        return pd.DataFrame({key: rows[key].iloc[:1].tolist(), "geometry": [[out]]})

    ship(shapes.sparkSession)
    return border.groupBy(key).applyInPandas(stitch, f"{key} {kind}, geometry {GEOMETRY}")
