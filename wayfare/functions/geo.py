"""Geodesy and plane geometry as Catalyst expressions: nothing here leaves the JVM.

A geometry is ARRAY<polygon>, a polygon ARRAY<ring> (outer ring first, then holes), a ring ARRAY<STRUCT<x, y>> whose last
point repeats the first. Lines are ARRAY<ARRAY<STRUCT<x, y>>>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
LINES = "array<array<struct<x:double,y:double>>>"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of 6,371 km."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_M


def mercator_y(lat: Column) -> Column:
    """Web-Mercator northing; latitudes are clipped to 85 degrees, a null stays null."""
    clipped = F.when(lat > 85, F.lit(85.0)).when(lat < -85, F.lit(-85.0)).otherwise(lat)
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clipped) / 2)) * MERCATOR_M


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERCATOR_M)) - F.lit(math.pi / 2))


class Utm:
    """Transverse Mercator of a UTM zone by the third-order Krueger series on the GRS80 ellipsoid."""

    A, INVERSE_F, K0 = 6_378_137.0, 298.257222101, 0.9996

    def __init__(self, epsg: int = 26911):
        if epsg // 100 in (269, 326):
            self.north = 0.0
        elif epsg // 100 == 327:
            self.north = 10_000_000.0
        else:
            raise ValueError(f"not a UTM zone: EPSG:{epsg}")
        self.meridian = math.radians((epsg % 100) * 6 - 183)
        n = 1 / (2 * self.INVERSE_F - 1)
        self.n = n
        self.radius = self.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        self.delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Easting and northing in metres."""
        e = 2 * math.sqrt(self.n) / (1 + self.n)
        atanh = lambda c: F.log((1 + c) / (1 - c)) / 2
        given = F.struct(F.sin(F.radians(lat)).alias("s"), (F.radians(lon) - self.meridian).alias("dl"))
        tau = lambda v: F.struct(F.sinh(atanh(v["s"]) - F.lit(e) * atanh(F.lit(e) * v["s"])).alias("t"), v["dl"].alias("dl"))
        plane = lambda v: F.struct(F.atan2(v["t"], F.cos(v["dl"])).alias("xi"), atanh(F.sin(v["dl"]) / F.sqrt(1 + v["t"] * v["t"])).alias("eta"))

        def grid(v: Column) -> Column:
            east, north = v["eta"], v["xi"]
            for j, a in enumerate(self.alpha, 1):
                east = east + F.lit(a) * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
                north = north + F.lit(a) * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            return F.struct(
                (F.lit(500_000.0) + self.K0 * self.radius * east).alias("e"), (F.lit(self.north) + self.K0 * self.radius * north).alias("n")
            )

        found = let(given, tau, plane, grid)
        return found["e"], found["n"]

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Latitude and longitude in degrees."""
        given = F.struct(((north - self.north) / (self.K0 * self.radius)).alias("xi"), ((east - 500_000.0) / (self.K0 * self.radius)).alias("eta"))

        def sphere(v: Column) -> Column:
            x, y = v["xi"], v["eta"]
            for j, b in enumerate(self.beta, 1):
                x = x - F.lit(b) * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
                y = y - F.lit(b) * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            return F.struct(x.alias("x"), y.alias("y"))

        conformal = lambda v: F.struct(F.asin(F.sin(v["x"]) / F.cosh(v["y"])).alias("chi"), F.atan2(F.sinh(v["y"]), F.cos(v["x"])).alias("dl"))

        def degrees(v: Column) -> Column:
            lat = v["chi"]
            for j, d in enumerate(self.delta, 1):
                lat = lat + F.lit(d) * F.sin(2 * j * v["chi"])
            return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.lit(self.meridian) + v["dl"]).alias("lon"))

        found = let(given, sphere, conformal, degrees)
        return found["lat"], found["lon"]


def let(value: Column, *steps) -> Column:
    """Applies steps one after another, each to the finished result of the one before: a value that a step uses several
    times is computed once, and generated code stays small."""
    held = F.array(value)
    for step in steps:
        held = F.transform(held, step)
    return F.element_at(held, 1)


def bing_pixel(lat: Column, lon: Column, level: int = 14) -> tuple[Column, Column]:
    """Global pixel of a point, truncated."""
    size, s = float(256 << level), F.sin(F.radians(lat))
    x = (lon + 180) / 360 * size
    y = (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size
    return x.cast("long"), y.cast("long")


def bing_tile(lat: Column, lon: Column, level: int = 14) -> tuple[Column, Column]:
    return tuple(F.floor(p / 256).cast("long") for p in bing_pixel(lat, lon, level))


def bing_corner(tile_x: Column, tile_y: Column, level: int = 14) -> tuple[Column, Column]:
    """Latitude and longitude of the north-west corner of a tile."""
    n = float(1 << level)
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * tile_y / n)))), 360 * tile_x / n - 180


def _segments(ring: Column, value) -> Column:
    """``value(a, b)`` for each segment of a ring or line."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), value)


def inside(x: Column, y: Column, geometry: Column) -> Column:
    """Even-odd test for each polygon with its holes; true if any polygon holds the point."""

    def crosses(a: Column, b: Column) -> Column:
        level = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(level & (x < at), 1).otherwise(0)

    def odd(polygon: Column) -> Column:
        count = F.aggregate(polygon, F.lit(0), lambda n, ring: n + F.aggregate(_segments(ring, crosses), F.lit(0), lambda s, v: s + v))
        return count % 2 == 1

    return F.exists(geometry, odd)


def _to_segment(x: Column, y: Column):
    def distance(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return let(t, lambda t: F.hypot(x - (a["x"] + t * dx), y - (a["y"] + t * dy)))

    return distance


def line_distance(x: Column, y: Column, lines: Column) -> Column:
    """Distance to the nearest segment of some lines."""
    return F.array_min(F.flatten(F.transform(lines, lambda line: _segments(line, _to_segment(x, y)))))


def border_distance(x: Column, y: Column, geometry: Column) -> Column:
    return line_distance(x, y, F.flatten(geometry))


def distance(x: Column, y: Column, geometry: Column) -> Column:
    """Distance to a geometry: 0 inside it or on its border."""
    return F.when(inside(x, y, geometry), F.lit(0.0)).otherwise(border_distance(x, y, geometry))


def intersects(x: Column, y: Column, geometry: Column) -> Column:
    """Inside or on the border."""
    return inside(x, y, geometry) | (border_distance(x, y, geometry) == 0)


def within(x: Column, y: Column, geometry: Column) -> Column:
    """Inside and not on the border."""
    return inside(x, y, geometry) & (border_distance(x, y, geometry) > 0)


def project(geometry: Column) -> Column:
    """A geometry in degrees to Web-Mercator metres."""
    return F.transform(
        geometry, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(mercator_x(q["x"]).alias("x"), mercator_y(q["y"]).alias("y"))))
    )


def project_lines(lines: Column) -> Column:
    return F.transform(lines, lambda r: F.transform(r, lambda q: F.struct(mercator_x(q["x"]).alias("x"), mercator_y(q["y"]).alias("y"))))


def bounds(geometry: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax."""
    points = F.flatten(F.flatten(geometry))
    xs, ys = F.transform(points, lambda q: q["x"]), F.transform(points, lambda q: q["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A rectangle as a geometry."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin))))
