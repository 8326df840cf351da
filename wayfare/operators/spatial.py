"""Joins of points with shapes: small units instead of whole geometries, met in cells that follow the load.

**Units.** A shape is cut into units with a box and a few edges each. ``strips`` serve containment: a polygon is cut into
strips, an edge is filed in every strip that it crosses, and a point is inside if the edges of its own strip to one side of
it are odd in number. A perimeter of 100,000 vertices thus costs a point the edges that a line across it meets, and a few
more, instead of all.
``runs`` serve distances: some consecutive edges each. A shape of any size is many small rows, none is replicated whole.

``rectangles`` are one unit each and serve both: a row for a point and a shape, so that pairs need no grouping and no shuffle.

**Few units** are broadcast (their number and edges are counted first), filed in cells as large as their box: cell sizes
are powers of four for width and height apart, so a unit lies in a few cells and a point looks into one cell of each size
in use. **Many units** meet the points in the leaves of a quad tree: points and units are counted in 4^``DEPTH`` cells, and
a cell is split while its points, or its pairs of points and units, are more than a task should have. What is still too
many in the finest cell is dealt over parts, by row and not by place, and its units are replicated to each part. **Few
points** are broadcast to many units, filed like few units.

**Places.** Points of one place meet the same shapes: ``by_place`` finds them once for each place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import kept

#: Units and edges that are broadcast, at most: some 60 MB, as each lies in up to six cells.
FEW_UNITS, FEW_EDGES = 50_000, 250_000
#: Points that are broadcast to many units, at most, times the cell sizes of the units.
FEW_POINTS = 250_000
#: Edges of a strip that a polygon's strips aim at, and of a run.
STRIP_EDGES, RUN = 8, 16
#: Levels of the quad tree; leaves for each shuffle partition, and pairs of points and units of a leaf, that it aims at.
DEPTH, LEAVES, PAIRS = 9, 16, 100_000_000
BOX = ["_x1", "_y1", "_x2", "_y2"]


#: Shapes, and vertices of all of them, that are written into a plan as a constant.
PLAN_SHAPES, PLAN_VERTICES = 50, 400


def constant(shapes: DataFrame, geometry: str = "geometry") -> Column | None:
    """Very few and simple shapes as a constant array of their rows, null if they are more: no join is needed then. Only
    rows within the bounds are fetched."""
    n = F.coalesce(F.size(F.flatten(F.flatten(geometry))), F.lit(0))
    rows = shapes.select(F.when(n <= PLAN_VERTICES, F.to_json(F.struct(*shapes.columns))).alias("row"), n.alias("n"))
    held = rows.limit(PLAN_SHAPES + 1).collect()
    if len(held) > PLAN_SHAPES or sum(r.n for r in held) > PLAN_VERTICES:
        return None
    kind = f"array<{shapes.schema.simpleString()}>"
    return F.from_json(F.lit("[" + ",".join(r.row for r in held) + "]"), kind)


def ring_edges(ring: Column) -> Column:
    """The edges (ax, ay, bx, by) of a ring or line."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edge = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), edge)


def _bounded(rows: DataFrame, edges: str = "edges") -> DataFrame:
    each = lambda pick, name: F.transform(edges, lambda e: pick(e[f"a{name}"], e[f"b{name}"]))
    return rows.withColumns({
        "_x1": F.array_min(each(F.least, "x")), "_y1": F.array_min(each(F.least, "y")),
        "_x2": F.array_max(each(F.greatest, "x")), "_y2": F.array_max(each(F.greatest, "y"))
    })


def strips(shapes: DataFrame, keep: list[str], geometry: str = "geometry") -> DataFrame:
    """Units for ``holds``: the kept columns, a box, the strip's number and the polygon's strips (base, height, count), and
    edges. A polygon is cut along the axis on which a line crosses fewer of its edges; ``_turned`` polygons have their axes
    exchanged in edges and strips. There is a strip for ``STRIP_EDGES`` edges, fewer if edges are long: on average an edge
    lies in no more than about two."""
    polygons = shapes.select(*keep, F.explode(geometry).alias("_polygon"))
    polygons = polygons.select(*keep, F.flatten(F.transform("_polygon", ring_edges)).alias("edges")).where(F.size("edges") > 0)
    polygons = _bounded(polygons)
    width, height = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    rise = lambda name: F.aggregate("edges", F.lit(0.0), lambda s, e: s + F.abs(e[f"a{name}"] - e[f"b{name}"]))
    crossed = lambda name, size: F.coalesce(rise(name) / F.nullif(size, F.lit(0.0)), F.lit(1.0))
    polygons = polygons.withColumns({"_cx": crossed("x", width), "_cy": crossed("y", height)}).withColumn("_turned", F.col("_cx") < F.col("_cy"))
    side = F.when(F.col("_turned"), width).otherwise(height)
    n = F.size("edges") / F.greatest(F.lit(float(STRIP_EDGES)), F.least("_cx", "_cy"))
    polygons = polygons.withColumn("_count", F.when(side > 0, F.greatest(F.lit(1), F.floor(n))).otherwise(1).cast("int"))
    polygons = polygons.withColumn("_height", F.when(F.col("_count") > 1, side / F.col("_count")))
    turn = lambda e: F.struct(e["ay"].alias("ax"), e["ax"].alias("ay"), e["by"].alias("bx"), e["bx"].alias("by"))
    polygons = polygons.withColumn("edges", F.when(F.col("_turned"), F.transform("edges", turn)).otherwise(F.col("edges")))
    polygons = polygons.withColumns({"_base": F.when(F.col("_turned"), F.col("_x1")).otherwise(F.col("_y1")), "_id": F.monotonically_increasing_id()})
    columns = [*keep, *BOX, "_base", "_height", "_count", "_turned"]
    whole = polygons.where("_count = 1").select(*columns, F.lit(0).alias("_strip"), "edges")
    tall = polygons.where("_count > 1").select("_id", F.struct(*columns).alias("_of"), F.explode("edges").alias("e"))
    low, high = (strip_of(f("e.ay", "e.by"), F.col("_of._base"), F.col("_of._height"), F.col("_of._count")) for f in (F.least, F.greatest))
    tall = tall.select("_id", "_of", "e", F.explode(F.sequence(low, high)).alias("_strip"))
    tall = tall.groupBy("_id", "_strip").agg(F.first("_of").alias("_of"), F.collect_list("e").alias("edges"))
    begin = F.col("_of._base") + F.col("_strip") * F.col("_of._height")
    # A strip's box is wider than the strip by a rounding error, so that a point is never above one and below the next.
    slack = F.col("_of._height") * 1e-6
    cut = {"1": begin - slack, "2": begin + F.col("_of._height") + slack}
    own = lambda c: F.when(F.col("_of._turned") == (c[1] == "x"), cut[c[2]]).otherwise(F.col(f"_of.{c}"))
    tall = tall.select(*[(own(c) if c in BOX else F.col(f"_of.{c}")).alias(c) for c in columns], "_strip", "edges")
    return whole.unionByName(tall)


def strip_of(y: Column, base: Column, height: Column, count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(F.floor((y - base) / height), F.lit(0)).cast("int"), count - 1))


def runs(shapes: DataFrame, keep: list[str], rings: Column) -> DataFrame:
    """Units for ``within``: the kept columns, a box and at most ``RUN`` consecutive edges. ``rings``: an array of rings or
    lines."""
    lines = shapes.select(*keep, F.explode(rings).alias("_ring")).select(*keep, ring_edges(F.col("_ring")).alias("_edges")).where(F.size("_edges") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("_edges") - 1) / RUN).cast("int")), lambda i: F.slice("_edges", i * RUN + 1, F.lit(RUN)))
    units = _bounded(lines.select(*keep, F.explode(pieces).alias("edges")))

    def ready(e: Column) -> Column:
        """An edge by its start, direction and squared length: what every distance needs is computed once for each edge."""
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        q = F.coalesce(F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(1.0))
        return F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), dx.alias("dx"), dy.alias("dy"), q.alias("q"))

    return units.withColumn("edges", F.transform("edges", ready))


def _to_edge(x: Column, y: Column, ax: Column, ay: Column, dx: Column, dy: Column, q: Column) -> Column:
    """Distance of a point to an edge."""
    t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / q, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def within(met: DataFrame, reach: float, x: str = "_x", y: str = "_y") -> DataFrame:
    """Points that met units of ``runs``, a row for each edge at most ``reach`` away, and the distance (_d)."""
    each = met.withColumn("_e", F.explode("edges")).drop("edges")  # a row an edge: compiled code instead of a loop in an expression
    return each.withColumn("_d", _to_edge(F.col(x), F.col(y), *[F.col(f"_e.{c}") for c in ("ax", "ay", "dx", "dy", "q")])).where(F.col("_d") <= reach).drop("_e")


def holds(border: bool, x: str = "_x", y: str = "_y") -> Column:
    """Whether the polygon of the strip that a point met holds it; its border belongs to it or not."""
    px, py = F.when(F.col("_turned"), F.col(y)).otherwise(F.col(x)), F.when(F.col("_turned"), F.col(x)).otherwise(F.col(y))

    def touched(e: Column) -> Column:
        beside = px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        q = F.coalesce(F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(1.0))
        return F.when(beside, _to_edge(px, py, e["ax"], e["ay"], dx, dy, q) == 0).otherwise(False)

    def crossed(e: Column) -> Column:
        at = (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return F.when(((e["ay"] > py) != (e["by"] > py)) & (px < at), 1).otherwise(0)

    odd = F.aggregate("edges", F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1
    own = strip_of(py, F.col("_base"), F.col("_height"), F.col("_count")) == F.col("_strip")
    return own & ((odd | F.exists("edges", touched)) if border else (odd & ~F.exists("edges", touched)))


def rectangles(shapes: DataFrame, keep: list[str], geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """Units of the shapes that are a rectangle along the axes, one each: the kept columns, a box and no edges. And the other
    shapes."""
    ring = F.flatten(F.flatten(geometry))
    p = [F.get(ring, F.lit(k)) for k in range(5)]
    flat = lambda a, b, name: a[name] == b[name]
    turns = lambda one, two: flat(p[0], p[1], one) & flat(p[1], p[2], two) & flat(p[2], p[3], one) & flat(p[3], p[4], two)
    closed = (F.size(geometry) == 1) & (F.size(F.flatten(geometry)) == 1) & (F.size(ring) == 5) & flat(p[0], p[4], "x") & flat(p[0], p[4], "y")
    solid = (p[0]["x"] != p[2]["x"]) & (p[0]["y"] != p[2]["y"])
    simple = F.coalesce(closed & solid & (turns("x", "y") | turns("y", "x")), F.lit(False))
    box = [f(p[0][c], p[2][c]).alias(f"_{c}{k}") for k, f in (("1", F.least), ("2", F.greatest)) for c in ("x", "y")]
    units = shapes.where(simple).select(*keep, *box, F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>").alias("edges"))
    return units, shapes.where(~simple)


def near(
    points: DataFrame, shapes: DataFrame, keep: list[str], reach: float, geometry: str = "geometry", x: str = "_x", y: str = "_y", few: bool | None = None
) -> DataFrame:
    """Points with each shape (told apart by the kept columns) at most ``reach`` away: a row for a point and a shape, with
    the distance (_d), 0 inside and on the border. Points are told apart by their columns. Pairs with rectangles are found
    by one task each, by compiled code, and need no shuffle; those with other shapes are grouped over the shape's units."""
    units, others = rectangles(shapes, keep, geometry)
    beyond = lambda v, low, high: F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(high), F.lit(0.0))
    found = meet(points, units, reach, x, y, few).withColumn("_d", F.hypot(beyond(x, "_x1", "_x2"), beyond(y, "_y1", "_y2"))).where(F.col("_d") <= reach)
    found = found.select(*points.columns, *keep, "_d")
    if others.isEmpty():
        return found
    held = meet(points, strips(others, keep, geometry), 0.0, x, y, few).where(holds(True, x, y)).select(*points.columns, *keep, F.lit(0.0).alias("_d"))
    edges = within(meet(points, runs(others, keep, F.flatten(geometry)), reach, x, y, few), reach, x, y).select(*points.columns, *keep, "_d")
    return found.unionByName(held.unionByName(edges).groupBy(*points.columns, *keep).agg(F.min("_d").alias("_d")))


def by_place(points: DataFrame, find: Callable[[DataFrame], DataFrame], x: str = "_x", y: str = "_y") -> DataFrame:
    """Points with what ``find`` returns for their place: it gets the distinct places (x, y) and returns rows with them."""
    places = kept(points.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct(), "places")
    return points.join(find(places), [x, y])


@dataclass(frozen=True)
class Measured:
    """Units, their edges, the cell sizes of their boxes (exponents of four), and the box of all."""

    units: int
    edges: int
    sizes: tuple[tuple[int, int], ...]
    box: tuple[float, float, float, float]

    @property
    def few(self) -> bool:
        return self.units <= FEW_UNITS and self.edges <= FEW_EDGES


def _size(low: str, high: str, reach: float) -> Column:
    width = F.col(high) - F.col(low) + 2 * reach
    return F.ceil(F.log2(F.greatest(width, F.lit(1e-9))) / 2).cast("int")


def measure(units: DataFrame, reach: float) -> Measured:
    """Counts that decide how points meet the units: one job over them."""
    size = F.struct(_size("_x1", "_x2", reach), _size("_y1", "_y2", reach))
    r = units.agg(F.count(F.lit(1)), F.sum(F.size("edges")), F.collect_set(size), *[(F.min if c[2] == "1" else F.max)(c) for c in BOX]).first()
    return Measured(r[0], r[1] or 0, tuple(sorted(tuple(s) for s in r[2])), tuple(r[3:]))


def _inside_box(reach: float, x: str, y: str) -> Column:
    return (F.col(x) >= F.col("_x1") - reach) & (F.col(x) <= F.col("_x2") + reach) & (F.col(y) >= F.col("_y1") - reach) & (F.col(y) <= F.col("_y2") + reach)


def meet(points: DataFrame, units: DataFrame, reach: float = 0.0, x: str = "_x", y: str = "_y", few: bool | None = None) -> DataFrame:
    """Points with the units whose box, widened by ``reach``, holds them: columns of both. A point without coordinates
    meets none. ``few``: whether units are broadcast, by default if they are few enough; if they are not, points are if
    these are few."""
    found = measure(units, reach)
    if not found.units:
        return points.join(units, F.lit(False))
    if found.few if few is None else few:
        return _by_size(points, units, reach, x, y, found)
    if few is None and points.count() * len(found.sizes) <= FEW_POINTS:
        return _by_size(points, units, reach, x, y, found, few_points=True)
    return _by_leaf(points, units, reach, x, y, found)


def _by_size(points: DataFrame, units: DataFrame, reach: float, x: str, y: str, found: Measured, few_points: bool = False) -> DataFrame:
    """Few units, or few points: broadcast in cells of the units' own sizes."""
    step = lambda size: F.pow(F.lit(4.0), size)
    span = lambda low, high, size: F.explode(F.sequence(F.floor((low - reach) / step(size)), F.floor((high + reach) / step(size))))
    filed = units.withColumns({"_sx": _size("_x1", "_x2", reach), "_sy": _size("_y1", "_y2", reach)})
    filed = filed.withColumn("_i", span(F.col("_x1"), F.col("_x2"), F.col("_sx")))
    filed = filed.withColumn("_j", span(F.col("_y1"), F.col("_y2"), F.col("_sy")))
    cells = [
        F.struct(
            F.lit(sx).alias("_sx"), F.lit(sy).alias("_sy"), F.floor(F.col(x) / 4.0**sx).alias("_i"), F.floor(F.col(y) / 4.0**sy).alias("_j")
        ) for sx, sy in found.sizes
    ]
    key = ["_sx", "_sy", "_i", "_j"]
    looked = points.withColumn("_cell", F.explode(F.array(*cells)) if len(cells) > 1 else cells[0])
    looked = looked.select(*points.columns, *[f"_cell.{c}" for c in key])
    both = F.broadcast(looked).join(filed, key) if few_points else looked.join(F.broadcast(filed), key)
    return both.where(_inside_box(reach, x, y)).drop(*key)


def _spread(c: Column) -> Column:
    """The bits of a number below 2^DEPTH, a zero between each two."""
    return sum((F.shiftleft(F.shiftright(c, k).bitwiseAND(1), 2 * k) for k in range(DEPTH)), F.lit(0))


class QuadTree:
    """Cells of a box, split by load. Codes are interleaved bits: a cell's ancestors are its code's leading bits."""

    def __init__(self, box: tuple[float, float, float, float], reach: float):
        x1, y1, x2, y2 = box
        self.x, self.y, self.reach = x1 - reach, y1 - reach, reach
        self.width, self.height = max(x2 - x1 + 2 * reach, 1e-9), max(y2 - y1 + 2 * reach, 1e-9)

    def _at(self, v: Column, base: float, size: float) -> Column:
        side = 1 << DEPTH
        return F.greatest(F.lit(0), F.least(F.floor((v - base) / size * side), F.lit(side - 1))).cast("long")

    def code(self, x: Column, y: Column) -> Column:
        """The finest cell of a point."""
        return F.shiftleft(_spread(self._at(y, self.y, self.height)), 1).bitwiseOR(_spread(self._at(x, self.x, self.width)))

    def within(self, x: str, y: str) -> Column:
        return F.col(x).between(self.x, self.x + self.width) & F.col(y).between(self.y, self.y + self.height)

    def grow(self, points: DataFrame, units: DataFrame, x: str, y: str) -> None:
        """Counts both sides and decides the leaves (level, cell, parts), and the leaf of each finest cell with points.
        Tables of at most 4^``DEPTH`` rows (262,144; 8 MB)."""
        middle = [(F.col("_x1") + F.col("_x2")) / 2, (F.col("_y1") + F.col("_y2")) / 2]
        of_points = points.where(self.within(x, y)).groupBy(self.code(F.col(x), F.col(y)).alias("code")).agg(F.count(F.lit(1)).alias("p"))
        of_units = units.groupBy(self.code(*middle).alias("code")).agg(F.count(F.lit(1)).alias("u"))
        fine = kept(of_points.join(of_units, "code", "full").na.fill(0, ["p", "u"]), "counts")
        total = fine.agg(F.sum("p")).first()[0] or 0
        limit = max(1, total // (LEAVES * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        ups = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")).withColumn("cell", self.up(F.col("code"), F.col("level")))
        loads = ups.groupBy("level", "cell").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        heavy = (F.col("p") > limit) | (F.col("p") * F.col("u") > PAIRS)
        parents = loads.where(heavy).select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
        leaves = loads.where((F.col("p") > 0) & (~heavy | (F.col("level") == DEPTH))).withColumn("parent", F.when(F.col("level") > 0, F.shiftright("cell", 2)))
        # A leaf's parent is split; a cell below a leaf has one that is not.
        leaves = leaves.join(parents, ["level", "parent"], "left_semi").unionByName(leaves.where("level = 0"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("p") / limit)).cast("int").alias("parts")
        self.leaves = kept(leaves.select("level", "cell", parts), "leaves")
        self.placed = ups.where("p > 0").select("code", "level", "cell").join(F.broadcast(self.leaves), ["level", "cell"])

    @staticmethod
    def up(code: Column, level: Column) -> Column:
        return F.call_function("shiftright", code, ((DEPTH - level) * 2).cast("int"))

    def dealt(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """Points with the leaf that has them, and one of its parts."""
        rows = points.where(self.within(x, y)).withColumn("code", self.code(F.col(x), F.col(y)))
        part = F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int").alias("_part")
        return rows.join(F.broadcast(self.placed), "code").select(*points.columns, F.col("level").alias("_level"), F.col("cell").alias("_leaf"), part)

    def replicated(self, units: DataFrame) -> DataFrame:
        """Units with every part of every leaf that their widened box touches. A box covers at most four cells at the level
        whose cells are as large; a leaf that it touches lies above or below one of them."""
        share = F.greatest((F.col("_x2") - F.col("_x1") + 2 * self.reach) / self.width, (F.col("_y2") - F.col("_y1") + 2 * self.reach) / self.height)
        level = F.greatest(F.lit(0), F.least(F.floor(-F.log2(F.greatest(share, F.lit(1e-9)))), F.lit(DEPTH))).cast("int")
        corner = lambda cx, cy: self.up(self.code(cx, cy), F.col("_l"))
        xs, ys = (F.col("_x1") - self.reach, F.col("_x2") + self.reach), (F.col("_y1") - self.reach, F.col("_y2") + self.reach)
        corners = F.array_distinct(F.array(*[corner(a, b) for a in xs for b in ys]))
        rows = units.withColumn("_u", F.monotonically_increasing_id()).withColumn("_l", level).withColumn("_c", F.explode(corners))
        above = rows.select("_u", *units.columns, "_c", "_l", F.explode(F.sequence(F.lit(0), F.col("_l"))).alias("level"))
        above = above.withColumn("cell", F.call_function("shiftright", F.col("_c"), ((F.col("_l") - F.col("level")) * 2).cast("int")))
        met = above.join(F.broadcast(self.leaves), ["level", "cell"])
        below = self.leaves.where("level > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("_l"))
        below = below.withColumn("_c", F.call_function("shiftright", F.col("cell"), ((F.col("level") - F.col("_l")) * 2).cast("int")))
        # The four cells of a box can lead to one leaf, by the same of both ways.
        once = lambda df: df.select("_u", *units.columns, "level", "cell", "parts").where(self._touches()).dropDuplicates(["_u", "level", "cell"])
        met = once(met).unionByName(once(rows.join(F.broadcast(below), ["_l", "_c"])))
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part")
        return met.select(*units.columns, F.col("level").alias("_level"), F.col("cell").alias("_leaf"), parts)

    def _touches(self) -> Column:
        """Whether a unit's widened box touches the leaf's box."""
        squeezed = lambda c: sum((F.shiftleft(F.shiftright(c, 2 * k).bitwiseAND(1), k) for k in range(DEPTH)), F.lit(0))
        i, j, cells = squeezed(F.col("cell")), squeezed(F.shiftright("cell", 1)), F.pow(F.lit(2.0), F.col("level"))

        def near(k: Column, base: Column, size: Column, low: str, high: str) -> Column:
            begins, ends = base + (k - 0.001) * size / cells, base + (k + 1.001) * size / cells
            return (F.col(low) - self.reach <= ends) & (F.col(high) + self.reach >= begins)

        return near(i, F.lit(self.x), F.lit(self.width), "_x1", "_x2") & near(j, F.lit(self.y), F.lit(self.height), "_y1", "_y2")


def _by_leaf(points: DataFrame, units: DataFrame, reach: float, x: str, y: str, found: Measured) -> DataFrame:
    """Many units: an equi-join on leaf and part, whose loads are bounded."""
    tree = QuadTree(found.box, reach)
    tree.grow(points, units, x, y)
    key = ["_level", "_leaf", "_part"]
    # A fixed number of partitions: rows are few bytes but many pairs, and adaptive execution would merge them by bytes.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, shared = (df.repartition(n, *key) for df in (tree.dealt(points, x, y), tree.replicated(units)))
    return rows.join(shared, key).where(_inside_box(reach, x, y)).drop(*key)


def nearest(points: DataFrame, shapes: DataFrame, key: str, keep: list[str], geometry: str = "geometry", first: float | None = None) -> DataFrame:
    """For each point (``key``, _x, _y) the nearest shape, however far: the kept columns and the distance (_d), 0 inside.
    Ties go to the least kept columns.

    Rings of growing reach: all shapes within a reach are met, so the nearest of them is the nearest of all, and only
    points that met none go on with four times the reach. ``first``: the first reach, by default a 64th of the shapes' box."""
    edges = runs(shapes, keep, F.flatten(geometry))
    found = measure(edges, 0.0)
    if not found.units:
        return points.select(key).where(F.lit(False)).join(shapes.select(*keep), F.lit(False)).withColumn("_d", F.lit(0.0))
    x1, y1, x2, y2 = found.box
    reach = first or max(x2 - x1, y2 - y1, 1e-9) / 64
    rank = F.struct("_d", *keep)
    inside = meet(points, strips(shapes, keep, geometry)).where(holds(border=True)).withColumn("_d", F.lit(0.0))
    done = kept(inside.groupBy(key).agg(F.min(rank).alias("_n")), "inside")
    rest = kept(points.where("_x is not null and _y is not null").join(done.select(key), key, "left_anti"), "rest")
    while not rest.isEmpty():
        close = within(meet(rest, edges, reach), reach)
        won = kept(close.groupBy(key).agg(F.min(rank).alias("_n")), "won")
        done = done.unionByName(won)
        rest = kept(rest.join(won.select(key), key, "left_anti"), "rest")
        reach *= 4
    return done.select(key, *[F.col(f"_n.{c}").alias(c) for c in keep], F.col("_n._d").alias("_d"))
