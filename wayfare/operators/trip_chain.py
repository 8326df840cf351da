"""Stop chains: clusters, merged, in order, with a role for each stop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import local_clock, overnight, resolve_tz
from ..functions.contracts import InputError
from ..functions.geo import haversine_m
from .clustering import ClusterConfig, as_time, cluster_array, merge_array, sorted_pings


@dataclass(frozen=True)
class TripChainConfig:
    home_radius_m: float = 400.0
    overnight_start_hour: int = 20
    overnight_end_hour: int = 7
    destination_min_dwell_s: float = 1800.0
    merge_nearby_stops: bool = True
    merge_distance_m: float = 120.0
    merge_gap_s: float = 3600.0
    classify_return: bool = True
    local_tz: str | None = None


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def build_trip_chain(
    pings: DataFrame, homes: DataFrame | None = None, user: str = "ID", time: str = "datetime", lat: str = "latitude",
    lon: str = "longitude", clustering: ClusterConfig | None = None, rules: TripChainConfig | None = None,
    local_tz: str | None = None, tie: str | None = None
) -> DataFrame:
    """The stop chain of every user. ``homes`` (ID, home_lat_4326, home_lon_4326) gives home and return stops; users without
    a home have none. The pings are shuffled once, on the user; later windows reuse that partitioning."""
    rules = rules or TripChainConfig()
    zone = resolve_tz(pings, time, local_tz if local_tz is not None else rules.local_tz)
    kind = "timestamp_ntz" if dict(pings.dtypes)[time] == "timestamp_ntz" else "timestamp"
    stops = sorted_pings(pings, user, time, lat, lon, tie).withColumn("c", cluster_array(F.col("pings"), clustering or ClusterConfig()))
    if rules.merge_nearby_stops:
        stops = stops.withColumn("c", merge_array(F.col("c"), rules.merge_distance_m, rules.merge_gap_s))
    stops = stops.select("user_id", F.posexplode("c").alias("pos", "c")).select("user_id", (F.col("pos") + 1).cast("long").alias("seq_idx"), "c.*")
    if homes is not None:
        known = first_rows(
            homes.select(F.col("ID").alias("user_id"), "home_lat_4326", "home_lon_4326"), ["user_id"],
            [F.col("home_lat_4326"), F.col("home_lon_4326")]
        )
        stops = stops.join(known, "user_id", "left")
    else:
        stops = stops.withColumns({"home_lat_4326": F.lit(None).cast("double"), "home_lon_4326": F.lit(None).cast("double")})
    by_user = Window.partitionBy("user_id").orderBy("seq_idx")
    here = (F.col("centroid_lat"), F.col("centroid_lon"))
    start, end = as_time(F.col("start_us"), kind), as_time(F.col("end_us"), kind)
    stops = stops.withColumns(
        {
            "distance_from_home_m": haversine_m(F.col("home_lat_4326"), F.col("home_lon_4326"), *here),
            "distance_from_prev_m": haversine_m(F.lag("centroid_lat").over(by_user), F.lag("centroid_lon").over(by_user), *here),
            "start_ts": start,
            "end_ts": end,
            "is_overnight": overnight(
                local_clock(start, kind, zone), local_clock(end, kind, zone), rules.overnight_start_hour, rules.overnight_end_hour
            ),
        }
    )
    at_home = F.coalesce(F.col("distance_from_home_m") <= rules.home_radius_m, F.lit(False))
    stops = stops.withColumn("_home", at_home)
    seen_away = F.coalesce(F.max(~F.col("_home")).over(by_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    home_role = F.when(seen_away, "return").otherwise("home") if rules.classify_return else F.lit("home")
    role = F.when(F.col("_home"), home_role).when(F.col("is_overnight"), "overnight").when(
        F.col("dwell_s") >= rules.destination_min_dwell_s, "destination"
    ).otherwise("intermediate")
    return stops.select(
        "user_id", "seq_idx", F.col("cluster_id").alias("stop_id"), "start_ts", "end_ts", "dwell_s", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"),
        "distance_from_home_m", "distance_from_prev_m", "is_overnight", role.alias("stop_role"),
    )


def compute_trip_chain(
    pings: DataFrame, homes: DataFrame | None = None, user: str = "ID", rules: TripChainConfig | None = None, local_tz: str | None = None
) -> DataFrame:
    """``build_trip_chain`` on tables with other usual names (GRID, LAT, LONG, TIMESTAMP or timestamp_ms in epoch
    milliseconds), always with the default clusters of 200 m and 300 s."""
    df = pings
    for wanted, others in (("ID", (user, "user_id", "GRID")), ("latitude", ("LAT", "lat")), ("longitude", ("LONG", "lon"))):
        found = next((c for c in others if c in df.columns), None)
        if wanted not in df.columns and found:
            df = df.withColumnRenamed(found, wanted)
    if "datetime" not in df.columns:
        ms = next((c for c in ("timestamp_ms", "TIMESTAMP") if c in df.columns), None)
        if ms is None:
            raise InputError("pings: missing column datetime")
        df = df.withColumn("datetime", F.timestamp_millis(F.col(ms).cast("long")))
    missing = [c for c in ("ID", "latitude", "longitude") if c not in df.columns]
    if missing:
        raise InputError(f"pings: missing columns {missing}")
    if homes is not None and (missing := [c for c in ("ID", "home_lat_4326", "home_lon_4326") if c not in homes.columns]):
        raise InputError(f"homes: missing columns {missing}")
    return build_trip_chain(df, homes, rules=rules, local_tz=local_tz)
