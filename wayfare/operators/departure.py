"""Departure and return times, and where a departure starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import delay_hours, local_clock, micros, resolve_tz
from ..functions.geo import haversine_m
from .clustering import ClusterConfig, cluster_array, duration_s, epoch_micros, merge_array, sorted_pings
from .intervals import islands, selected_island, stay_bounds
from .trip_chain import first_rows

__all__ = ["delay_hours", "find_origin", "infer_departures", "infer_from_trip_chain"]


def _reference(df: DataFrame, order: str | None, zone: str | None) -> Column | None:
    return None if order is None else F.to_date(local_clock(F.col(order), dict(df.dtypes)[order], zone))


def _with_orders(df: DataFrame, keys: list[str], orders: DataFrame | None) -> tuple[DataFrame, str | None]:
    if orders is None:
        return df, None
    one = orders.groupBy(*keys).agg(F.min("order_start").alias("order_start"))
    return df.join(one, keys, "left"), "order_start"


def infer_from_distance(
    pings: DataFrame, distance: str, away_radius: float = 1000.0, orders: DataFrame | None = None, user: str = "user_id",
    time: str = "datetime", local_tz: str | None = None
) -> DataFrame:
    """Departure and return of every user from a distance column: days with a ping beyond ``away_radius`` form runs; the
    run that belongs to the order (``orders``: user, order_start) must last more than one day."""
    if time not in pings.columns:
        pings = pings.withColumn(time, F.timestamp_millis(F.col("timestamp_ms").cast("long")))
    zone = resolve_tz(pings, time, local_tz)
    kind = dict(pings.dtypes)[time]
    away = pings.where(F.col(distance) > away_radius).withColumn("day", F.to_date(local_clock(F.col(time), kind, zone)))
    runs, order = _with_orders(islands(away, [user]), [user], orders)
    chosen = selected_island(runs, [user], _reference(runs, order, zone)).where("last_day > first_day").select(
        user, "first_day", "last_day", "n_days"
    )
    return stay_bounds(away.select(user, "day", time), chosen, [user], F.col(time), F.col(time)).select(user, "departure", "return")


def infer_from_trip_chain(chain: DataFrame, away_radius: float = 1000.0, orders: DataFrame | None = None, local_tz: str | None = None) -> DataFrame:
    """Every user's departure and return from its stops: (user_id, departure, return, origin_type); users who did not leave
    have null times and origin 'home', others origin 'activity'."""
    zone = resolve_tz(chain, "start_ts", local_tz)
    kind = dict(chain.dtypes)["start_ts"]
    far = F.col("distance_from_home_m").try_cast("double") > away_radius
    away = chain.where(F.col("stop_role").isin("intermediate", "overnight", "destination") & far).withColumn(
        "day", F.to_date(local_clock(F.col("start_ts"), kind, zone))
    )
    runs, order = _with_orders(islands(away, ["user_id"]), ["user_id"], orders)
    chosen = selected_island(runs, ["user_id"], _reference(runs, order, zone)).where("last_day > first_day").select(
        "user_id", "first_day", "last_day", "n_days"
    )
    found = stay_bounds(away.select("user_id", "day", "start_ts", "end_ts"), chosen, ["user_id"], F.col("start_ts"), F.col("end_ts"))
    users = chain.select("user_id").distinct().join(found.select("user_id", "departure", "return"), "user_id", "left")
    return users.withColumn("origin_type", F.when(F.col("departure").isNotNull(), "activity").otherwise("home"))


def find_origin(
    pings: DataFrame, homes: DataFrame, fire_start: Column, R_a: float = 200.0, T_a: str = "5min", home_radius: float = 200.0,
    max_origin_distance_m: float = 50_000.0, user: str = "ID", time: str = "datetime", lat: str = "latitude",
    lon: str = "longitude", tie: str | None = None
) -> DataFrame:
    """Where each resident of ``homes`` was when the fire started: (user, origin_lat, origin_lon, origin_type).

    A ping within ``home_radius`` of home from 2 hours before to 1 hour after means home. Otherwise the stop of the 12
    hours before that holds the time, else the last one that ended by then, if it lies beyond ``home_radius`` and within
    ``max_origin_distance_m`` of home; else home. ``fire_start`` is a column of ``homes``."""
    place = F.struct("home_lat_4326", "home_lon_4326")
    start = homes.groupBy(F.col("ID").alias("user_id")).agg(F.min_by(place, place).alias("h"), F.min(fire_start).alias("fire"))
    if dict(pings.dtypes)[time] == "timestamp_ntz":
        fire_us = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("fire").cast("timestamp_ntz")).cast("timestamp"))
    else:
        fire_us = micros(F.col("fire"))
    start = start.select("user_id", F.col("h.home_lat_4326").alias("home_lat"), F.col("h.home_lon_4326").alias("home_lon"), fire_us.alias("fire_us"))
    hours = lambda h: F.lit(int(h * 3_600_000_000))
    # Only the 13 hours that count are gathered by user.
    fires = start.select(F.col("user_id").alias("_user"), F.col("fire_us").alias("_fire"))
    since = epoch_micros(pings, time) - F.col("_fire")
    wanted = pings.join(fires, F.col(user) == F.col("_user")).where((since >= -hours(12)) & (since <= hours(1))).drop("_user", "_fire")
    rows = start.join(sorted_pings(wanted, user, time, lat, lon, tie), "user_id", "left")
    near = F.exists(
        "pings",
        lambda p: (p["t"] >= F.col("fire_us") - hours(2)) & (p["t"] <= F.col("fire_us") + hours(1)) & (
            haversine_m(F.col("home_lat"), F.col("home_lon"), p["lat"], p["lon"]) <= home_radius
        )
    )
    before = F.filter("pings", lambda p: (p["t"] >= F.col("fire_us") - hours(12)) & (p["t"] <= F.col("fire_us")))
    rows = rows.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("before", before)
    rows = rows.withColumn("stops", merge_array(cluster_array(F.col("before"), ClusterConfig(R_a, duration_s(T_a)))))
    holds = F.filter("stops", lambda c: (c["start_us"] <= F.col("fire_us")) & (F.col("fire_us") <= c["end_us"]))
    ended = F.filter("stops", lambda c: c["end_us"] <= F.col("fire_us"))
    stop = F.coalesce(F.get(holds, F.lit(0)), F.get(ended, F.size(ended) - 1))
    rows = rows.withColumn("stop", stop)
    far = haversine_m(F.col("home_lat"), F.col("home_lon"), F.col("stop.centroid_lat"), F.col("stop.centroid_lon"))
    away = ~F.col("near") & F.coalesce((far > home_radius) & (far <= max_origin_distance_m), F.lit(False))
    return rows.select(
        F.col("user_id").alias(user),
        F.when(away, F.col("stop.centroid_lat")).otherwise(F.col("home_lat")).alias("origin_lat"),
        F.when(away, F.col("stop.centroid_lon")).otherwise(F.col("home_lon")).alias("origin_lon"),
        F.when(away, "activity").otherwise("home").alias("origin_type"),
    )


def infer_departures(
    pings: DataFrame, homes: DataFrame | None = None, orders: DataFrame | None = None, method: str = "home_based",
    home_radius: float = 200.0, away_radius: float = 1000.0, user: str = "ID", time: str = "datetime",
    trip_chain: DataFrame | None = None, local_tz: str | None = None
) -> DataFrame:
    """Departure and return of every user: (user, departure, return, origin_type).

    ``trip_chain`` takes precedence. 'home_based' uses the distance from home (column ``distance_to_home``, or computed from
    ``homes``); 'activity_based' the distance from the origin at the order's time (``find_origin``); 'auto' the origin only
    for users whose origin is an activity."""
    if method not in ("home_based", "activity_based", "auto"):
        raise ValueError(f"unknown method: {method}")
    if trip_chain is not None:
        own = orders.withColumnRenamed(user, "user_id") if orders is not None else None
        return infer_from_trip_chain(trip_chain, away_radius, own, local_tz).withColumnRenamed("user_id", user)
    rows = pings
    if homes is not None and "distance_to_home" not in rows.columns:
        known = first_rows(
            homes.select(F.col("ID").alias(user), "home_lat_4326", "home_lon_4326"), [user],
            [F.col("home_lat_4326").asc_nulls_last(), F.col("home_lon_4326").asc_nulls_last()]
        )
        rows = rows.join(known, user).withColumn(
            "distance_to_home", haversine_m(F.col("home_lat_4326"), F.col("home_lon_4326"), F.col("latitude"), F.col("longitude"))
        )
    origin = None
    if method != "home_based" and homes is not None and orders is not None:
        timed = homes.join(orders.groupBy(F.col(user).alias("ID")).agg(F.min("order_start").alias("order_start")), "ID")
        origin = find_origin(pings, timed, F.col("order_start"), home_radius=home_radius, user=user, time=time)
        rows = rows.join(origin, user, "left")
        moved = F.col("origin_type") == "activity" if method == "auto" else F.col("origin_type").isNotNull()
        away = haversine_m(F.col("origin_lat"), F.col("origin_lon"), F.col("latitude"), F.col("longitude"))
        rows = rows.withColumn("distance_to_origin", F.when(moved, away).otherwise(F.col("distance_to_home")))
    distance = "distance_to_origin" if origin is not None else "distance_to_home"
    found = infer_from_distance(rows, distance, away_radius, orders, user, time, local_tz)
    out = pings.select(user).distinct().join(found, user, "left")
    if origin is None:
        return out.withColumn("origin_type", F.lit("home"))
    return out.join(origin.select(user, "origin_type"), user, "left").withColumn("origin_type", F.coalesce("origin_type", F.lit("home")))
