"""Destinations of residents, and their land use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.clock import local_clock, resolve_tz
from ..functions.contracts import TRIP_CHAIN, InputError
from ..functions.text import number, standardize_type
from .spatial import holds, meet, runs, strips, within
from .trip_chain import first_rows


def anchored_merge(stops: Column, merge_distance_km: float) -> Column:
    """Of sorted stops (date, lat, lon), those farther than the distance from the last kept one."""

    def step(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        near = geo.haversine_m(last["lat"], last["lon"], s["lat"], s["lon"]) / 1000.0 <= merge_distance_km
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(s)))

    kind = "array<struct<date:string,lat:double,lon:double>>"
    return F.aggregate(stops.cast(kind), F.array().cast(kind), step)


def _roles(include_intermediate: bool, include_return: bool) -> list[str]:
    return ["overnight", "destination", *(["intermediate"] if include_intermediate else []), *(["return"] if include_return else [])]


def _home_table(homes: DataFrame) -> DataFrame:
    missing = [c for c in ("ID", "home_lat_4326", "home_lon_4326") if c not in homes.columns]
    if missing:
        raise InputError(f"homes: missing columns {missing}")
    return first_rows(
        homes.select("ID", F.col("home_lat_4326").alias("_hlat"), F.col("home_lon_4326").alias("_hlon")), ["ID"], [F.col("_hlat"), F.col("_hlon")]
    )


def _chain_of_destinations(daily: DataFrame, merge_distance_km: float, source: str) -> DataFrame:
    """Daily stops (ID, date, lat, lon, home) to destinations in order."""
    grouped = daily.groupBy("ID").agg(
        F.sort_array(F.collect_list(F.struct("date", "lat", "lon"))).alias("s"), F.min(F.struct("_hlat", "_hlon")).alias("h")
    )
    rows = grouped.select("ID", "h", F.posexplode(anchored_merge(F.col("s"), merge_distance_km)).alias("pos", "d"))
    far = F.round(geo.haversine_m(F.col("h._hlat"), F.col("h._hlon"), F.col("d.lat"), F.col("d.lon")) / 1000.0, 3)
    return rows.select(
        "ID", F.col("d.lat").alias("dest_lat"), F.col("d.lon").alias("dest_lon"), F.col("d.date").alias("dest_date"),
        far.alias("eu_distance_km"), (F.col("pos") + 1).cast("long").alias("dest_order"), F.lit(source).alias("source_role")
    )


def infer_destinations(
    stops: DataFrame, homes: DataFrame, merge_distance_km: float = 0.4, home_buffer_m: float = 400.0,
    include_intermediate: bool = True, include_return: bool = False, lat: str = "stop_lat_4326", lon: str = "stop_lon_4326",
    date: str = "stop_date", duration: str = "duration", local_tz: str | None = None
) -> DataFrame:
    """Destinations from nightly stops: the longest stop of each day, beyond the home buffer, merged with the last kept one
    where closer than ``merge_distance_km``. A table with all trip-chain columns is treated as a chain."""
    if all(c in stops.columns for c in TRIP_CHAIN.required):
        return infer_destinations_from_chain(stops, homes, merge_distance_km, home_buffer_m, include_intermediate, include_return, local_tz)
    rows = stops
    for wanted, other in (("ID", "user_id"), (lat, "lat"), (lon, "lon")):
        if wanted not in rows.columns and other in rows.columns:
            rows = rows.withColumnRenamed(other, wanted)
    if date not in rows.columns and "start_ts" in rows.columns:
        zone = resolve_tz(rows, "start_ts", local_tz)
        rows = rows.withColumn(date, F.to_date(local_clock(F.col("start_ts"), dict(rows.dtypes)["start_ts"], zone)).cast("string"))
    if duration not in rows.columns:
        rows = rows.withColumn(duration, number(F.col("dwell_s")) / 60.0 if "dwell_s" in rows.columns else F.lit(None).cast("double"))
    if "stop_role" in rows.columns:
        rows = rows.where(F.col("stop_role").isin(_roles(include_intermediate, include_return)))
    rows = rows.select(
        "ID", F.col(date).cast("string").alias("date"), F.col(lat).cast("double").alias("lat"),
        F.col(lon).cast("double").alias("lon"), F.col(duration).cast("double").alias("_d")
    )
    daily = first_rows(rows.where("ID is not null and date is not null"), ["ID", "date"], [F.col("_d").desc_nulls_last(), F.col("lat"), F.col("lon")])
    away = daily.join(_home_table(homes), "ID").where(geo.haversine_m(F.col("_hlat"), F.col("_hlon"), F.col("lat"), F.col("lon")) > home_buffer_m)
    return _chain_of_destinations(away, merge_distance_km, "intermediate_or_overnight" if include_intermediate else "overnight")


def infer_destinations_from_chain(
    chain: DataFrame, homes: DataFrame, merge_distance_km: float = 0.4, home_buffer_m: float = 400.0,
    include_intermediate: bool = True, include_return: bool = False, local_tz: str | None = None
) -> DataFrame:
    """Destinations from a trip chain: for each local day the stop of the highest role (overnight, destination,
    intermediate, return), then the longest, beyond the home buffer, merged as above."""
    zone = resolve_tz(chain, "start_ts", local_tz)
    rows = chain.where(F.col("stop_role").isin(_roles(include_intermediate, include_return)))
    day = F.to_date(local_clock(F.col("start_ts"), dict(chain.dtypes)["start_ts"], zone)).cast("string")
    rank = F.when(F.col("stop_role") == "overnight", 3).when(F.col("stop_role") == "destination", 2).when(
        F.col("stop_role") == "intermediate", 1
    ).otherwise(0)
    rows = rows.select(F.col("user_id").alias("ID"), day.alias("date"), "lat", "lon", "dwell_s", "seq_idx", rank.alias("_rank"))
    away = rows.join(_home_table(homes), "ID").where(geo.haversine_m(F.col("_hlat"), F.col("_hlon"), F.col("lat"), F.col("lon")) > home_buffer_m)
    daily = first_rows(away, ["ID", "date"], [F.desc("_rank"), F.col("dwell_s").desc_nulls_last(), F.col("seq_idx")])
    return _chain_of_destinations(daily, merge_distance_km, "trip_chain")


def classify_destinations(
    destinations: DataFrame, parcels: DataFrame | None, roads: DataFrame | None = None, buffer_m: float = 50.0,
    road_buffer_m: float = 20.0, type_col: str = "UseType"
) -> DataFrame:
    """Adds dest_type: the standard type of the parcel that holds the point; else of the first parcel within ``buffer_m``;
    else 'road' within ``road_buffer_m`` of a road line; else 'unknown'. Without parcels the type is null.

    Parcels (geometry, ``type_col``) and roads (lines) are cut into units of a few edges, which meet the points."""
    if parcels is None:
        return destinations.withColumn("dest_type", F.lit(None).cast("string"))
    points = destinations.select(
        "ID", "dest_order", F.col("dest_lon").alias("_x"), F.col("dest_lat").alias("_y")
    ).where("_x is not null and _y is not null")
    keys = ["ID", "dest_order"]
    ordinal = F.xxhash64(F.to_json(F.struct("geometry"))) if "parcel_id" not in parcels.columns else F.col("parcel_id")
    shapes = parcels.select("geometry", F.col(type_col).cast("string").alias("_type"), ordinal.alias("_ordinal"))
    held = meet(points, strips(shapes, ["_type", "_ordinal"])).where(holds(border=False)).groupBy(*keys).agg(F.min_by("_type", "_ordinal").alias("_held"))
    flat = points.select(*keys, geo.mercator_x(F.col("_x")).alias("_x"), geo.mercator_y(F.col("_y")).alias("_y"))
    # Of points that no parcel holds, those within reach of a border are those within reach of a parcel.
    borders = runs(shapes.select(geo.project(F.col("geometry")).alias("geometry"), "_type", "_ordinal"), ["_type", "_ordinal"], F.flatten("geometry"))
    close = within(meet(flat, borders, buffer_m), buffer_m).groupBy(*keys).agg(F.min_by("_type", "_ordinal").alias("_close"))
    out = destinations.join(held, keys, "left").join(close, keys, "left") if buffer_m > 0 else destinations.join(held, keys, "left").withColumn(
        "_close", F.lit(None).cast("string")
    )
    if roads is not None:
        beside = meet(flat, runs(roads.select(geo.project_lines(F.col("lines")).alias("lines")), [], F.col("lines")), road_buffer_m)
        beside = within(beside, road_buffer_m).where(F.col("_d") < road_buffer_m).select(*keys).distinct().withColumn("_road", F.lit("road"))
        out = out.join(beside, keys, "left")
    else:
        out = out.withColumn("_road", F.lit(None).cast("string"))
    return out.withColumn("dest_type", standardize_type(F.coalesce("_held", "_close", "_road", F.lit("unknown")))).drop("_held", "_close", "_road")
