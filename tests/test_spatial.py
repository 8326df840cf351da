"""Joins of points with shapes against plain loops, and the loads of their tasks."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.operators import spatial
from wayfare.operators.residents import mark_outside
from wayfare.operators.zones import assign_regions, classify_zones, nearest_zones

SHAPE = f"shape long, geometry {geo.GEOMETRY}"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(r, cx, cy, size, n):
    """A jagged ring around a centre."""
    return ring([(cx + size * (0.4 + r.random()) * math.cos(2 * math.pi * k / n), cy + size * (0.4 + r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)])


def comb(n, wide):
    """A ring whose teeth a line along one axis crosses n times, and a line along the other twice."""
    teeth = [(k, 5 + (k % 2) * 4 + (k % 7) * 0.1) for k in range(n)]
    points = [*teeth, (n - 1, 0), (0, 0)]
    return ring(points if wide else [(y, x) for x, y in points])


def shapes(r):
    square = ring([(0, 0), (4, 0), (4, 4), (0, 4)])
    hole = ring([(1, 1), (2, 1), (2, 2), (1, 2)])
    rows = [(1, [[square, hole]]), (2, [[square], [ring([(6, 6), (8, 6), (7, 9)])]]), (3, [[star(r, 10, 10, 4, 300)]]), (4, [[comb(400, True)]])]
    rows += [(5, [[comb(250, False)]]), (6, [[ring([(3, 3), (3, 3), (3, 3)])]]), (7, []), (8, None), (9, [[star(r, 5, 5, 0.01, 40)], [star(r, 20, 2, 3, 60)]])]
    return rows + [(10 + k, [[star(r, r.uniform(0, 30), r.uniform(0, 30), r.uniform(0.1, 3), r.randint(3, 30))]]) for k in range(40)]


def places(r, n=300):
    spots = [(0.0, 0.0), (1.0, 1.5), (2.0, 2.0), (4.0, 2.0), (3.0, 3.0), (6.0, 6.0), (-50.0, 3.0), (None, 1.0), (1.5, None)]
    spots += [(float(r.randint(0, 12)), float(r.randint(0, 12))) for _ in range(60)]
    return [(k, *p) for k, p in enumerate(spots + [(r.uniform(-2, 34), r.uniform(-2, 34)) for _ in range(n)])]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    points = spark.createDataFrame(places(r), "id long, _x double, _y double").repartition(3).cache()
    return points, spark.createDataFrame(shapes(r), SHAPE).cache()


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select("id", "shape", *columns).collect()), key=str)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("border", [True, False])
def test_strips_hold_what_whole_polygons_hold(tables, few, border):
    points, polygons = tables
    x, y, g = F.col("_x"), F.col("_y"), F.col("geometry")
    plain = points.where("_x is not null and _y is not null").crossJoin(polygons).where((geo.intersects if border else geo.within)(x, y, g))
    units = spatial.strips(polygons, ["shape"])
    assert units.where("_count > 1").count() > 20 and units.where("_turned").count() > 5
    assert units.where("shape in (4, 5)").agg(F.max(F.size("edges"))).first()[0] < 40
    found = spatial.meet(points, units, few=few).where(spatial.holds(border)).select("id", "shape").distinct()
    assert pairs(found) == pairs(plain) and len(pairs(found)) > 100


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("reach", [0.3, 5.0])
def test_runs_measure_what_whole_borders_measure(tables, few, reach):
    points, polygons = tables
    far = geo.border_distance(F.col("_x"), F.col("_y"), F.col("geometry"))
    plain = points.where("_x is not null and _y is not null").crossJoin(polygons).withColumn("d", far).where(F.col("d") <= reach)
    units = spatial.runs(polygons, ["shape"], F.flatten("geometry"))
    assert units.agg(F.max(F.size("edges"))).first()[0] <= spatial.RUN
    found = spatial.within(spatial.meet(points, units, reach, few=few), reach).groupBy("id", "shape").agg(F.min("_d").alias("d"))
    assert pairs(found, F.round("d", 9)) == pairs(plain, F.round("d", 9))


def test_no_shapes_and_no_points(tables):
    points, polygons = tables
    for some, units in ((points, spatial.strips(polygons.limit(0), ["shape"])), (points.limit(0), spatial.strips(polygons, ["shape"]))):
        for few in (True, False):
            assert spatial.meet(some, units, few=few).where(spatial.holds(True)).select("id", "shape").collect() == []
    assert spatial.nearest(points, polygons.limit(0), "id", ["shape"]).collect() == []


def test_a_crowd_at_one_place_is_dealt_over_tasks(spark):
    """Nine points in ten share one spot; leaves and parts keep all tasks alike."""
    n = 60_000
    spot = F.when(F.col("id") % 10 < 9, F.lit(0.5))
    points = spark.range(n).select("id", F.coalesce(spot, F.rand(1)).alias("_x"), F.coalesce(spot, F.rand(2)).alias("_y"))
    lots = spark.range(3000).select(F.col("id").alias("shape"), F.rand(3).alias("a"), F.rand(4).alias("b"), (F.rand(5) * 0.02).alias("c"))
    lots = lots.select("shape", geo.rectangle(F.col("a"), F.col("b"), F.col("a") + F.col("c"), F.col("b") + F.col("c")).alias("geometry"))
    units = spatial.strips(lots, ["shape"]).unionByName(spatial.strips(spark.range(1).select(F.lit(-1).cast("long").alias("shape"), geo.rectangle(*(F.lit(float(v)) for v in (0, 0, 1, 1))).alias("geometry")), ["shape"]))
    tree = spatial.QuadTree(spatial.measure(units, 0.0).box, 0.0)
    tree.grow(points, units, "_x", "_y")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tree.dealt(points, "_x", "_y")
    assert dealt.count() == n
    sizes = [r["count"] for r in dealt.groupBy("_level", "_leaf", "_part").count().collect()]
    assert max(sizes) <= 1.2 * n / (spatial.LEAVES * parts) + 5
    tasks = [r["count"] for r in dealt.repartition(parts, "_level", "_leaf", "_part").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == parts and max(tasks) <= 3 * statistics.median(tasks)
    shared = tree.replicated(units)
    assert shared.where("shape = -1").count() == tree.leaves.agg(F.sum("parts")).first()[0]  # the wide one is everywhere, once
    assert shared.count() == shared.select("shape", "_level", "_leaf", "_part").distinct().count()


def test_many_pairs_split_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 1000)
    monkeypatch.setattr(spatial, "LEAVES", 1)
    points = spark.range(400).select("id", F.rand(1).alias("_x"), F.rand(2).alias("_y"))
    lots = spark.range(2000).select(F.col("id").alias("shape"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    lots = lots.select("shape", geo.rectangle(F.col("a"), F.col("b"), F.col("a") + 0.01, F.col("b") + 0.01).alias("geometry"))
    tree = spatial.QuadTree((0.0, 0.0, 1.0, 1.0), 0.0)
    tree.grow(points, spatial.strips(lots, ["shape"]), "_x", "_y")
    assert tree.leaves.agg(F.min("level")).first()[0] >= 3


def test_nearest_however_far(tables):
    points, polygons = tables
    known = points.where("_x is not null and _y is not null")
    d = geo.distance(F.col("_x"), F.col("_y"), F.col("geometry"))
    plain = known.crossJoin(polygons.where("size(flatten(geometry)) > 0")).withColumn("d", d).groupBy("id").agg(F.min("d").alias("d"))
    found = spatial.nearest(points, polygons, "id", ["shape"], first=0.05)
    assert sorted(tuple(r) for r in found.select("id", F.round("_d", 9)).collect()) == sorted(tuple(r) for r in plain.select("id", F.round("d", 9)).collect())


def test_nearest_zone_of_homes(spark):
    zones = spark.range(2).select(
        F.concat(F.lit("z"), "id").alias("zoneId"), geo.rectangle(F.col("id"), F.col("id"), F.col("id") + 0.5, F.col("id") + 0.5).alias("geometry")
    )
    homes = spark.createDataFrame([("a", 0.1, 0.1), ("b", 60.0, 20.0), ("c", None, 1.0), ("a", 5.0, 5.0)], "ID string, home_lat_4326 double, home_lon_4326 double")
    found = {r.ID: r for r in nearest_zones(homes, zones).collect()}
    assert found["a"].zoneId == "z0" and found["a"].zone_meters == 0 and found["b"].zoneId == "z1" and found["b"].zone_meters > 6e6
    assert found["c"].zoneId is None and len(found) == 3


@pytest.mark.parametrize("edges", [250_000, 0])
def test_labels_by_joins_equal_labels_by_constant(spark, monkeypatch, edges):
    r = random.Random(5)
    zones = spark.createDataFrame(
        [(f"z{k % 9}", ["Evacuation Order", "Evacuation Warning", "Normal", None][k % 4], f"fire {k % 3}", [None, "2024-01-02", "2024-01-01"][k % 3],
          [[star(r, -118 + r.random(), 34 + r.random(), 0.1, 8)]]) for k in range(30)],
        f"zoneId string, most_extreme_status string, incident_name string, datetime string, geometry {geo.GEOMETRY}"
    )
    homes = spark.createDataFrame(
        [(str(k), -118.2 + 1.4 * r.random(), 33.8 + 1.4 * r.random()) for k in range(200)] + [("n", None, 1.0)], "ID string, home_lon_4326 double, home_lat_4326 double"
    )

    def found():
        labels = sorted((tuple(x) for x in classify_zones(homes, zones, 8000.0).collect()), key=str)
        regions = sorted((tuple(x) for x in assign_regions(homes, zones, "zoneId").collect()), key=str)
        at = homes.select("ID", geo.mercator_x(F.col("home_lon_4326")).alias("x"), geo.mercator_y(F.col("home_lat_4326")).alias("y"))
        return labels, regions, sorted((x.ID, x.is_outside_zone) for x in mark_outside(at, "x", "y", zones, 3000.0).collect())

    expected = found()
    assert {x[3] for x in expected[0]} == {"Order", "Warning", "Unknown", "Buffer", "Outside"}
    monkeypatch.setattr(spatial, "PLAN_SHAPES", 0)
    monkeypatch.setattr(spatial, "FEW_EDGES", edges)
    assert found() == expected


def test_near_gives_a_row_for_a_point_and_a_shape(spark):
    r = random.Random(12)
    rows = shapes(r) + [(100 + k, [[ring([(x, y), (x, y + h), (x + w, y + h), (x + w, y)])]]) for k in range(30) for x, y, w, h in [[r.uniform(0, 20) for _ in range(4)]]]
    rows = [s for s in rows if s[1]]
    df = spark.createDataFrame(rows, SHAPE)
    boxes, others = spatial.rectangles(df, ["shape"])
    assert boxes.count() == 30 and others.count() == len(rows) - 30
    points = [(k, r.uniform(-2, 30), r.uniform(-2, 30)) for k in range(150)] + [(200, 1.5, 1.5), (201, 4.0, 2.0), (202, None, 1.0)]
    places = spark.createDataFrame(points, "p long, _x double, _y double")
    for few in (None, False):
        found = [(x.p, x.shape, round(x._d, 6)) for x in spatial.near(places, df, ["shape"], 0.7, few=few).collect()]
        inside = {(x.p, x.shape) for x in spatial.meet(places, spatial.strips(df, ["shape"])).where(spatial.holds(border=True)).collect()}
        expected = set()
        for p, x, y in points:
            for s, polygons in rows if x is not None else []:
                edges = [(a, b) for polygon in polygons for line in polygon for a, b in zip(line, line[1:], strict=False)]
                d = 0.0 if (p, s) in inside else min(to_edge(x, y, a, b) for a, b in edges)
                if d <= 0.7:
                    expected.add((p, s, round(d, 6)))
        assert len(found) == len(set(found)) and set(found) == expected


def to_edge(x, y, a, b):
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = min(max(((x - a["x"]) * dx + (y - a["y"]) * dy) / ((dx * dx + dy * dy) or 1.0), 0.0), 1.0)
    return math.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def test_points_of_one_place_are_met_once_and_pairs_with_rectangles_not_shuffled(spark):
    lots = [(k, [[ring([(k % 20, 0), (k % 20, 5), (k % 20 + 6, 5), (k % 20 + 6, 0)])]]) for k in range(400)]
    df = spark.createDataFrame(lots, SHAPE)
    points = spark.createDataFrame([(k, 10.5 + k % 3, 2.0) for k in range(300)] + [(300, None, 2.0)], "p long, _x double, _y double")
    seen = []

    def count(places):
        seen.append(places.count())
        met = spatial.near(places, df, ["shape"], 0.25, few=False)
        assert met._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0].count("Exchange") == 0
        return met.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("n"))

    found = {x.p: x.n for x in spatial.by_place(points, count).collect()}
    assert seen == [3] and set(found) == set(range(300))
    assert all(found[p] == sum(k % 20 - 0.25 <= 10.5 + p % 3 <= k % 20 + 6.25 for k in range(400)) for p in found)


def test_few_points_are_broadcast_to_many_units(spark, monkeypatch):
    r = random.Random(5)
    df = spark.createDataFrame([s for s in shapes(r) if s[1]], SHAPE)
    points = spark.createDataFrame([(k, r.uniform(-2, 30), r.uniform(-2, 30)) for k in range(200)] + [(200, None, 1.0)], "p long, _x double, _y double")
    units = spatial.strips(df, ["shape"])
    rows = lambda met: sorted((x.p, x.shape) for x in met.where(spatial.holds(border=True)).collect())
    expected = rows(spatial.meet(points, units, few=True))
    monkeypatch.setattr(spatial, "FEW_UNITS", 1)
    met = spatial.meet(points, units)
    assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString() and rows(met) == expected
