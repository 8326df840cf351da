"""Zone labels of homes: Order, Warning, Unknown, Buffer or Outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import title_case
from .spatial import constant, holds, meet, nearest, runs, strips, within
from .trip_chain import first_rows


def zone_priority(status: Column | None, order_status: str = "Evacuation Order", warning_status: str = "Evacuation Warning") -> Column:
    """2 order, 1 warning, 0 anything else; 2 where there is no status at all."""
    if status is None:
        return F.lit(2)
    return F.when(status.contains(order_status), 2).when(status.contains(warning_status), 1).otherwise(0)


LABELS = ["OrderStart", "OrderEnd", "zoneId", "incident_name", "most_extreme_status"]


def prepared_zones(zones: DataFrame, order_status: str = "Evacuation Order", warning_status: str = "Evacuation Warning") -> DataFrame:
    """Zones with priority and every column that labels may use, as text (null where the input has none)."""
    have = set(zones.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    status = F.col("most_extreme_status") if "most_extreme_status" in have else None
    return zones.select(
        "geometry", text("datetime").alias("OrderStart"), *[text(c).alias(c) for c in LABELS[1:]],
        zone_priority(status, order_status, warning_status).alias("_priority")
    )


def _in_order(*columns: str) -> list[Column]:
    """Columns for a comparison of structs, nulls last."""
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


def classify_zones(
    homes: DataFrame, zones: DataFrame, buffer_distance: float = 2000.0, order_status: str = "Evacuation Order",
    warning_status: str = "Evacuation Warning"
) -> DataFrame:
    """Homes (ID, home_lat_4326, home_lon_4326, ...) with ZoneType, and OrderStart, OrderEnd, zoneId, FireEvent and
    most_extreme_status of the deciding zone.

    Of the zones that hold or touch a home, the one with the highest priority decides, then the earliest datetime. A home
    outside all zones but within ``buffer_distance`` Web-Mercator metres of an order or warning zone is Buffer and takes
    FireEvent from the nearest. Homes with the same ID count once."""
    keys = [F.col("home_lat_4326").asc_nulls_last(), F.col("home_lon_4326").asc_nulls_last()]
    one = homes.withColumn("_r", F.row_number().over(Window.partitionBy("ID").orderBy(*keys))).where("_r = 1").drop("_r")
    ready = prepared_zones(zones, order_status, warning_status)
    at = one.select("ID", F.col("home_lon_4326").alias("_x"), F.col("home_lat_4326").alias("_y")).where("_x is not null and _y is not null")
    few = constant(boxed(ready))
    if few is not None:
        out = _labelled(one, few, buffer_distance)
    else:
        won, closest = _decided(at, ready, buffer_distance)
        out = one.join(won, "ID", "left").join(closest, "ID", "left")
    label = F.when(F.col("z._priority") == 2, "Order").when(F.col("z._priority") == 1, "Warning").when(F.col("z").isNotNull(), "Unknown").when(
        F.col("b").isNotNull(), "Buffer"
    ).otherwise("Outside")
    added = {
        "ZoneType": label, "OrderStart": F.col("z.OrderStart"), "OrderEnd": F.col("z.OrderEnd"), "zoneId": F.col("z.zoneId"),
        "FireEvent": title_case(F.coalesce("z.incident_name", "b.incident_name")),
        "most_extreme_status": F.col("z.most_extreme_status")
    }
    return out.select(*[c for c in one.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def boxed(zones: DataFrame) -> DataFrame:
    """Zones with their geometry in Web-Mercator metres, and the boxes of both."""
    rows = zones.withColumn("flat", geo.project(F.col("geometry")))
    for name, of in (("box", "geometry"), ("flat_box", "flat")):
        x1, y1, x2, y2 = geo.bounds(F.col(of))
        rows = rows.withColumn(name, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
    return rows


def near_box(p: Column, box: Column, reach: float) -> Column:
    return (p["x"] >= box["x1"] - reach) & (p["x"] <= box["x2"] + reach) & (p["y"] >= box["y1"] - reach) & (p["y"] <= box["y2"] + reach)


def _labelled(homes: DataFrame, zones: Column, buffer_distance: float) -> DataFrame:
    """Homes with the deciding zone (z) and the nearest active one (b), from a constant array of zones."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lon, lat = F.col("home_lon_4326"), F.col("home_lat_4326")
    order = lambda z, *names: [v for c in names for v in (z[c].isNull().alias(f"no_{c}"), z[c].alias(f"by_{c}"))]

    def decide(p: Column) -> Column:
        held = F.filter(zones, lambda z: F.when(near_box(p, z["box"], 0.0), geo.intersects(p["x"], p["y"], z["geometry"])).otherwise(False))

        def ranked(z: Column) -> Column:
            values = [z[c].alias(c) for c in ("_priority", *LABELS)]
            return F.struct((-z["_priority"]).alias("p"), *order(z, "OrderStart", "zoneId", "incident_name"), *values)

        return F.array_min(F.transform(held, ranked))

    def approach(p: Column) -> Column:
        close = F.filter(zones, lambda z: (z["_priority"] > 0) & near_box(p, z["flat_box"], buffer_distance))

        def ranked(z: Column) -> Column:
            far = geo.distance(p["x"], p["y"], z["flat"]).alias("d")
            return F.struct(far, *order(z, "zoneId", "OrderStart", "incident_name"), z["incident_name"].alias("incident_name"))

        return F.array_min(F.filter(F.transform(close, ranked), lambda z: z["d"] <= buffer_distance))

    known = lon.isNotNull() & lat.isNotNull()
    rows = homes.withColumn("z", F.when(known, geo.let(point(lon, lat), decide)))
    nearest_ = F.when(known & F.col("z").isNull(), geo.let(point(geo.mercator_x(lon), geo.mercator_y(lat)), approach))
    return rows.withColumn("b", nearest_)


def _decided(at: DataFrame, ready: DataFrame, buffer_distance: float) -> tuple[DataFrame, DataFrame]:
    """The same as two tables by ID, from joins with the zones' strips and borders."""
    held = meet(at, strips(ready, ["_priority", *LABELS])).where(holds(border=True))
    best = F.struct(-F.col("_priority"), *_in_order("OrderStart", "zoneId", "incident_name"))
    won = held.groupBy("ID").agg(F.min_by(F.struct("_priority", *LABELS), best).alias("z"))
    active = ready.where("_priority > 0").withColumn("_flat", geo.project(F.col("geometry")))
    borders = runs(active, ["zoneId", "OrderStart", "incident_name"], F.flatten("_flat"))
    rest = at.join(won.select("ID"), "ID", "left_anti").select("ID", geo.mercator_x(F.col("_x")).alias("_x"), geo.mercator_y(F.col("_y")).alias("_y"))
    close = within(meet(rest, borders, buffer_distance), buffer_distance)
    first = F.struct("_d", *_in_order("zoneId", "OrderStart", "incident_name"))
    closest = close.groupBy("ID").agg(F.min_by(F.struct("incident_name"), first).alias("b"))
    return won, closest


def assign_regions(
    points: DataFrame, regions: DataFrame, name: str, lat: str = "home_lat_4326", lon: str = "home_lon_4326", otherwise: str = "Other"
) -> DataFrame:
    """Adds the name of the first region (in order of names) that holds a point; ``otherwise`` outside all."""
    shapes = regions.select("geometry", F.col(name).alias("_name"))
    few = constant(shapes)
    if few is not None:
        x, y = F.col(lon), F.col(lat)
        held = F.filter(few, lambda r: geo.within(x, y, r["geometry"]))
        found = F.when(x.isNotNull() & y.isNotNull(), F.array_min(F.transform(held, lambda r: r["_name"])))
        return points.withColumn(name, F.coalesce(found, F.lit(otherwise)))
    at = first_rows(points.select("ID", F.col(lon).alias("_x"), F.col(lat).alias("_y")), ["ID"], [F.col("_x").asc_nulls_last(), F.col("_y").asc_nulls_last()])
    at = at.where("_x is not null and _y is not null")
    found = meet(at, strips(shapes, ["_name"])).where(holds(border=False)).groupBy("ID").agg(F.min("_name").alias("_name"))
    return points.join(found, "ID", "left").withColumn(name, F.coalesce("_name", F.lit(otherwise))).drop("_name")


def nearest_zones(homes: DataFrame, zones: DataFrame) -> DataFrame:
    """For each home (ID, home_lat_4326, home_lon_4326) the nearest zone, however far: zoneId, incident_name, and the
    distance in Web-Mercator metres, 0 inside. Homes without coordinates, and all homes where there is no zone, have nulls."""
    one = first_rows(
        homes.select("ID", "home_lat_4326", "home_lon_4326"), ["ID"], [F.col("home_lat_4326").asc_nulls_last(), F.col("home_lon_4326").asc_nulls_last()]
    )
    at = one.select("ID", geo.mercator_x(F.col("home_lon_4326")).alias("_x"), geo.mercator_y(F.col("home_lat_4326")).alias("_y"))
    flat = prepared_zones(zones).select("zoneId", "incident_name", geo.project(F.col("geometry")).alias("geometry"))
    found = nearest(at, flat, "ID", ["zoneId", "incident_name"])
    return one.select("ID").join(found, "ID", "left").withColumnRenamed("_d", "zone_meters")
