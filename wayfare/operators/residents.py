"""Ping-level stops of study residents, and one behaviour record for each resident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.clock import local_clock, resolve_tz, seconds_between
from ..functions.text import number
from .intervals import run_array
from .spatial import constant, holds, meet, runs, strips, within
from .zones import boxed, near_box

MILES = 0.000621371


def outside_zones(x: Column, y: Column, zones: Column, buffer_m: float) -> Column:
    """Whether a Web-Mercator point lies at ``buffer_m`` or farther from every zone; true for a missing point. ``zones``: a
    constant array (flat, flat_box)."""

    def near(p: Column) -> Column:
        close = lambda z: F.when(near_box(p, z["flat_box"], buffer_m), geo.distance(p["x"], p["y"], z["flat"]) < buffer_m).otherwise(False)
        return F.exists(zones, close)

    # The point is computed once for each row, not once for each segment that it is compared with.
    return F.when(x.isNotNull() & y.isNotNull(), ~geo.let(F.struct(x.alias("x"), y.alias("y")), near)).otherwise(True)


def mark_outside(rows: DataFrame, x: str, y: str, zones: DataFrame, buffer_m: float) -> DataFrame:
    """Adds is_outside_zone. A few simple zones become part of the plan; the strips and edges of others meet the distinct
    points, which serves perimeters of any number and length."""
    few = constant(boxed(zones.select("geometry")).select("geometry", "flat", "flat_box"))
    if few is not None:
        return rows.withColumn("is_outside_zone", outside_zones(F.col(x), F.col(y), few, buffer_m))
    flat = zones.select(geo.project(F.col("geometry")).alias("geometry"))
    points = rows.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null").distinct()
    held = meet(points, strips(flat, [])).where(holds(border=True)).select("_x", "_y") if buffer_m > 0 else points.limit(0)
    close = within(meet(points, runs(flat, [], F.flatten("geometry")), buffer_m), buffer_m).where(F.col("_d") < buffer_m).select("_x", "_y")
    close = held.unionByName(close).distinct().withColumn("_outside", F.lit(False))
    found = rows.join(close, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left")
    return found.withColumn("is_outside_zone", F.coalesce("_outside", F.lit(True))).drop("_x", "_y", "_outside")


def impute_distance(rows: DataFrame, user: str, time: list[str], distance: str) -> DataFrame:
    """Fills a missing distance with the user's last one before it, 0 at the start; users with more than half of their
    distances missing are left out."""
    everything, so_far = Window.partitionBy(user), Window.partitionBy(user).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_missing", F.avg(F.col(distance).isNull().cast("double")).over(everything)).where("_missing <= 0.5").drop("_missing")
    return rows.withColumn(distance, F.coalesce(F.last(distance, ignorenulls=True).over(so_far), F.lit(0.0)))


def compute_stops(
    pings: DataFrame, zoned_homes: DataFrame, zones: DataFrame, buffer_meters: float = 2000.0, local_tz: str | None = None
) -> DataFrame:
    """Pings (ID, LAT, LONG, datetime) of residents whose ZoneType is not Outside, with Web-Mercator distance from home in
    metres (dist_meters) and miles (eu_distance), and is_outside_zone against all zones widened by ``buffer_meters``."""
    wanted = ["ZoneType", "OrderStart", *[c for c in ("FireEvent", "OrderEnd") if c in zoned_homes.columns]]
    homes = zoned_homes.where(~F.col("ZoneType").eqNullSafe("Outside"))
    homes = homes.withColumn("_r", F.row_number().over(Window.partitionBy("ID").orderBy("home_lat_4326", "home_lon_4326"))).where("_r = 1")
    homes = homes.select(
        "ID", geo.mercator_x(F.col("home_lon_4326")).alias("home_lon"), geo.mercator_y(F.col("home_lat_4326")).alias("home_lat"), *wanted
    )
    # No hint: joined by a shuffle on ID, the pings are already dealt for the windows that follow; Spark may still broadcast.
    kind = dict(pings.dtypes)["datetime"]
    zone = resolve_tz(pings, "datetime", local_tz)
    clock = local_clock(F.col("datetime"), kind, zone) if local_tz else (F.try_to_timestamp("datetime") if kind == "string" else F.col("datetime"))
    lat, lon = ("LAT", "LONG") if "LAT" in pings.columns else ("latitude", "longitude")
    rows = pings.select("ID", number(F.col(lat)).alias("LAT"), number(F.col(lon)).alias("LONG"), clock.alias("stop_date")).join(homes, "ID")
    rows = rows.withColumns({"lon_grid": geo.mercator_x(F.col("LONG")), "lat_grid": geo.mercator_y(F.col("LAT"))})
    dx, dy = F.col("lon_grid") - F.col("home_lon"), F.col("lat_grid") - F.col("home_lat")
    rows = rows.withColumn("dist_meters", F.sqrt(dx * dx + dy * dy)).withColumn("eu_distance", F.col("dist_meters") * MILES)
    rows = mark_outside(rows, "lon_grid", "lat_grid", zones, buffer_meters)
    return impute_distance(rows, "ID", ["stop_date", "LAT", "LONG"], "eu_distance")


def resident_category(departure: Column, return_: Column, start: Column, end: Column, fire: Column, zone: Column) -> Column:
    """The category of a resident who left: a tree of its own, different from that of single records."""
    early = F.when(return_ < start, "NER").when(departure < fire, "UR").otherwise("SELE")
    full = F.when(return_ > end, F.when(zone == "Warning", "FEUW").otherwise("FEUO")).otherwise("PERE")
    during = F.when(zone == "Buffer", "SEFN").when(zone.isin("Warning", "Order"), full).otherwise("UR")
    return F.when(start.isNull(), "UR").when(departure < start, early).when(departure < end, during).otherwise("UR")


def infer_metrics(
    stops: DataFrame, fire_starts: dict[str, str], fire_end: str = "2025-01-14", min_dist_miles: float = 0.25,
    min_evac_days: int = 2, min_evac_days_buffer: int = 1, local_tz: str | None = None
) -> DataFrame:
    """One record for each resident: Category, DepartureDate, ReturnDate, DelayHours, zone attributes, is_evacuee. Times are
    on the local clock (TIMESTAMP_NTZ); strings in OrderStart and OrderEnd without a zone are local already."""
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    zone = resolve_tz(stops, "stop_date", local_tz)
    rows = stops.withColumn("stop_date", local_clock(F.col("stop_date"), dict(stops.dtypes)["stop_date"], zone))

    def clock(name: str) -> Column:
        if name not in stops.columns:
            return F.lit(None).cast("timestamp_ntz")
        if dict(stops.dtypes)[name] == "timestamp":
            return local_clock(F.col(name), "timestamp", zone)
        return F.col(name).try_cast("timestamp_ntz")

    event = F.col("FireEvent") if "FireEvent" in stops.columns else F.lit("Unknown")
    home = F.col("home_lon") if "home_lon" in stops.columns else F.lit(None).cast("double")
    rows = rows.withColumns({"_order": clock("OrderStart"), "_end": clock("OrderEnd"), "_event": event, "_home": home})
    # One pass: a row for each resident and day, then one for each resident, with its first stop and its away days.
    away = F.col("is_outside_zone") & (F.col("eu_distance") >= min_dist_miles)
    first = F.struct("stop_date", "eu_distance", "ZoneType", "_order", "_end", "_event", "_home")
    at = F.when(away, F.col("stop_date"))
    daily = rows.where("ID is not null").groupBy("ID", F.to_date("stop_date").alias("day")).agg(
        F.min(first).alias("f"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    days = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("day", "first", "last")))
    firsts = daily.groupBy("ID").agg(F.min("f").alias("f"), F.sort_array(days).alias("days"))
    firsts = firsts.select("ID", "f.ZoneType", "f._order", "f._end", "f._event", "f._home", "days")
    known = F.create_map(*[x for k, v in fire_starts.items() for x in (F.lit(k), ntz(v))]) if fire_starts else None
    earliest = F.least(*[ntz(v) for v in fire_starts.values()]) if len(fire_starts) > 1 else ntz(next(iter(fire_starts.values()), None))
    fire = F.coalesce(F.try_element_at(known, F.col("_event")), earliest) if known is not None else earliest
    firsts = firsts.withColumn("fire_start", fire).withColumn(
        "_start", F.when(F.col("_order").isNull() & F.col("ZoneType").isin("Buffer", "Outside"), F.col("fire_start")).otherwise(F.col("_order"))
    )
    firsts = firsts.withColumn("OrderEnd", F.coalesce("_end", ntz(fire_end) + F.expr("INTERVAL 23 HOURS")))
    reference = F.to_date("_start")
    ends = F.filter(run_array(F.col("days")), lambda r: reference.isNull() | (r["last_day"] >= reference))
    needed = F.when(F.col("ZoneType") == "Buffer", min_evac_days_buffer).otherwise(min_evac_days)
    out = firsts.withColumn("_run", F.get(ends, F.lit(0))).withColumn("_run", F.when(F.col("_run.n_days") >= needed, F.col("_run")))
    out = out.withColumns({"DepartureDate": F.col("_run.departure"), "ReturnDate": F.col("_run.return")})
    rule = resident_category(F.col("DepartureDate"), F.col("ReturnDate"), F.col("_start"), F.col("OrderEnd"), F.col("fire_start"), F.col("ZoneType"))
    category = F.when(F.col("DepartureDate").isNull(), "NER").otherwise(rule)
    late = F.when(F.col("_start").isNotNull(), F.greatest(F.lit(0.0), seconds_between(F.col("_start"), F.col("DepartureDate")) / 3600.0))
    return out.select(
        "ID", category.alias("Category"), "DepartureDate", "ReturnDate", F.when(
            F.col("DepartureDate").isNotNull(), late
        ).alias("DelayHours"), "ZoneType", F.col("_start").alias("OrderStart"), "OrderEnd",
        F.col("_event").alias("FireEvent"), "fire_start", F.col("_home").alias("home_lon"), (category != "NER").alias("is_evacuee"),
    )


def unique_devices(pings: DataFrame) -> DataFrame:
    return pings.agg(F.count_distinct("ID").alias("n_devices"))


__all__ = ["compute_stops", "impute_distance", "infer_metrics", "mark_outside", "outside_zones", "resident_category", "unique_devices"]
