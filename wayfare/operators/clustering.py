"""Stay clusters: one pass over a user's pings in time order, as a fold inside the JVM.

A ping joins the open cluster unless it lies more than ``radius_m`` from the cluster's running centroid or more than
``max_gap_s`` after its last ping. A closed cluster counts if it lasts ``min_dwell_s``; ids number all clusters, also those
that do not count. Pings without time or coordinates are left out. Equal times are ordered by ``tie``, then position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..functions.geo import haversine_m

CLUSTER = "struct<cluster_id:bigint,centroid_lat:double,centroid_lon:double,start_us:bigint,end_us:bigint,n_points:bigint,dwell_s:double>"


@dataclass(frozen=True)
class ClusterConfig:
    radius_m: float = 200.0
    min_dwell_s: float = 300.0
    max_gap_s: float | None = None


def as_time(value: Column, kind: str) -> Column:
    """Microseconds back to a timestamp of the input's kind."""
    found = F.timestamp_micros(value)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), found.cast("timestamp_ntz")) if kind == "timestamp_ntz" else found


def epoch_micros(df: DataFrame, time: str) -> Column:
    """Microseconds of a time column. A naive time is a wall clock: its distance from the epoch is taken as if it were UTC,
    whatever the session's zone."""
    kind = dict(df.dtypes)[time]
    at = F.try_to_timestamp(F.col(time)) if kind == "string" else F.col(time)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp"))
    return micros(at)


def sorted_pings(df: DataFrame, user: str, time: str, lat: str, lon: str, tie: str | None = None) -> DataFrame:
    """A row for each user with all its pings in order: ``pings`` of (t, tie, lat, lon). One shuffle on the user."""
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    mark = F.col(tie).cast("string") if tie else F.lit("")
    rows = df.select(F.col(user).alias("user_id"), epoch_micros(df, time).alias("t"), mark.alias("tie"), y.alias("lat"), x.alias("lon"))
    rows = rows.where("user_id is not null and t is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "tie", "lat", "lon"))).alias("pings"))


def _summary(a: Column) -> Column:
    return F.struct(
        a["id"].alias("cluster_id"), (a["lat"] / a["n"]).alias("centroid_lat"), (a["lon"] / a["n"]).alias("centroid_lon"), a["from"].alias("start_us"),
        a["to"].alias("end_us"), a["n"].alias("n_points"), ((a["to"] - a["from"]) / F.lit(1e6)).alias("dwell_s"),
    )


def _breaks(a: Column, p: Column, config: ClusterConfig) -> Column:
    far = haversine_m(a["lat"] / a["n"], a["lon"] / a["n"], p["lat"], p["lon"]) > config.radius_m
    if config.max_gap_s is not None:
        far = far | ((p["t"] - a["to"]) / F.lit(1e6) > config.max_gap_s)
    return far


def _state(id_: Column, n: Column, lat: Column, lon: Column, from_: Column, to: Column, out: Column) -> Column:
    return F.struct(
        id_.cast("long").alias("id"), n.cast("long").alias("n"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"),
        from_.cast("long").alias("from"), to.cast("long").alias("to"), out.alias("out")
    )


def _fold(pings: Column, config: ClusterConfig, out_type: str, on_start, on_join, on_close) -> Column:
    """The state machine; ``on_*`` give the array of outputs that a step appends (or None)."""
    none = F.array().cast(f"array<{out_type}>")
    zero = F.lit(0)

    def step(a: Column, p: Column) -> Column:
        closed = (a["to"] - a["from"]) / F.lit(1e6) >= config.min_dwell_s
        ended = F.concat(a["out"], F.when(closed, on_close(a)).otherwise(none)) if on_close else a["out"]
        first, new, grown = a["n"] == 0, _breaks(a, p, config), a["out"]
        started = lambda out: F.concat(out, on_start(a["id"] + 1, p)) if on_start else out
        if on_join:
            grown = F.concat(grown, on_join(a, p))
        fresh = lambda out: _state(a["id"] + 1, F.lit(1), p["lat"], p["lon"], p["t"], p["t"], out)
        grow = _state(a["id"], a["n"] + 1, a["lat"] + p["lat"], a["lon"] + p["lon"], a["from"], p["t"], grown)
        return F.when(first, fresh(started(a["out"]))).when(new, fresh(started(ended))).otherwise(grow)

    def finish(a: Column) -> Column:
        closed = (a["n"] > 0) & ((a["to"] - a["from"]) / F.lit(1e6) >= config.min_dwell_s)
        return F.concat(a["out"], F.when(closed, on_close(a)).otherwise(none))

    start = _state(zero, zero, F.lit(0.0), F.lit(0.0), zero, zero, none)
    return F.aggregate(pings, start, step, finish)


def cluster_array(pings: Column, config: ClusterConfig) -> Column:
    """Closed clusters of a sorted ping array."""
    return _fold(pings, config, CLUSTER, None, None, lambda a: F.array(_summary(a).cast(CLUSTER)))


def merge_array(clusters: Column, merge_distance_m: float = 120.0, merge_gap_s: float = 3600.0) -> Column:
    """Joins a cluster to the one before it if it starts within ``merge_gap_s`` and lies within ``merge_distance_m`` of its
    (merged) centroid. A merged cluster takes the last given id plus one."""
    none = F.array().cast(f"array<{CLUSTER}>")

    def step(a: Column, c: Column) -> Column:
        last = F.get(a["out"], F.size(a["out"]) - 1)
        near = ((c["start_us"] - last["end_us"]) / F.lit(1e6) <= merge_gap_s) & (
            haversine_m(last["centroid_lat"], last["centroid_lon"], c["centroid_lat"], c["centroid_lon"]) <= merge_distance_m
        )
        n = last["n_points"] + c["n_points"]
        mean = lambda k: (last[k] * last["n_points"] + c[k] * c["n_points"]) / n
        both = F.struct(
            (a["id"] + 1).alias("cluster_id"), mean("centroid_lat").alias("centroid_lat"), mean("centroid_lon").alias("centroid_lon"), last["start_us"].alias("start_us"),
            c["end_us"].alias("end_us"), n.alias("n_points"), ((c["end_us"] - last["start_us"]) / F.lit(1e6)).alias("dwell_s"),
        ).cast(CLUSTER)
        joins = F.coalesce(near, F.lit(False))
        kept = F.when(joins, F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0)))).otherwise(a["out"])
        return F.struct(
            F.when(joins, a["id"] + 1).otherwise(c["cluster_id"]).alias("id"), F.concat(kept, F.array(F.when(joins, both).otherwise(c))).alias("out")
        )

    return F.aggregate(clusters, F.struct(F.lit(0).cast("long").alias("id"), none.alias("out")), step, lambda a: a["out"])


def cluster_points(
    df: DataFrame, user: str = "ID", time: str = "datetime", lat: str = "latitude", lon: str = "longitude",
    config: ClusterConfig | None = None, tie: str | None = None
) -> DataFrame:
    """Stay clusters of every user: user_id, cluster_id, centroid, start_time, end_time, n_points, dwell_s."""
    kind = "timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp"
    found = sorted_pings(df, user, time, lat, lon, tie).select(
        "user_id", F.explode(cluster_array(F.col("pings"), config or ClusterConfig())).alias("c")
    )
    return found.select(
        "user_id", "c.cluster_id", "c.centroid_lat", "c.centroid_lon", as_time(F.col("c.start_us"), kind).alias("start_time"),
        as_time(F.col("c.end_us"), kind).alias("end_time"), "c.n_points", "c.dwell_s"
    )


def cluster_events(
    df: DataFrame, user: str = "ID", time: str = "datetime", lat: str = "latitude", lon: str = "longitude",
    config: ClusterConfig | None = None, tie: str | None = None
) -> DataFrame:
    """Life-cycle events of every user in order: cluster_started, cluster_updated, cluster_closed (with n_points and
    dwell_s of the closed cluster). On a break, closed comes before started."""
    kind = "timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp"
    event = "struct<event_type:string,cluster_id:bigint,at_us:bigint,n_points:bigint,dwell_s:double>"

    def of(name: str, id_: Column, at: Column, n: Column | None = None, dwell: Column | None = None) -> Column:
        none = F.lit(None)
        return F.array(
            F.struct(
                F.lit(name).alias("event_type"), id_.alias("cluster_id"), at.alias("at_us"),
                (n if n is not None else none.cast("long")).alias("n_points"),
                (dwell if dwell is not None else none.cast("double")).alias("dwell_s")
            ).cast(event)
        )

    found = _fold(
        F.col("pings"), config or ClusterConfig(), event,
        lambda id_, p: of("cluster_started", id_, p["t"]),
        lambda a, p: of("cluster_updated", a["id"], p["t"]),
        lambda a: of("cluster_closed", a["id"], a["to"], a["n"], (a["to"] - a["from"]) / F.lit(1e6)),
    )
    rows = sorted_pings(df, user, time, lat, lon, tie).select("user_id", F.posexplode(found).alias("seq", "e"))
    return rows.select(
        "user_id", (F.col("seq") + 1).cast("long").alias("seq"), "e.event_type", "e.cluster_id",
        as_time(F.col("e.at_us"), kind).alias("event_time"), "e.n_points", "e.dwell_s"
    )


def incremental_cluster(df: DataFrame, R_a: float = 200.0, T_a: str = "5min", **columns) -> DataFrame:
    """Activity clusters: centroid, start, end and number of pings."""
    found = cluster_points(df, config=ClusterConfig(R_a, duration_s(T_a)), **columns)
    return found.select(
        "user_id", "centroid_lat", "centroid_lon", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("n_points").alias("n")
    )


def duration_s(text: str | float) -> float:
    """Seconds of a duration such as '5min', '1h', '90s', '2D', '300ms'."""
    import re

    if not isinstance(text, str):
        return float(text)
    m = re.fullmatch(r"\s*([\d.]*)\s*(ms|s|sec|min|T|m|h|H|hours?|D|days?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    unit = {
        "ms": 1e-3, "s": 1.0, "sec": 1.0, "min": 60.0, "T": 60.0, "m": 60.0, "h": 3600.0, "H": 3600.0, "hour": 3600.0,
        "hours": 3600.0, "D": 86400.0, "day": 86400.0, "days": 86400.0
    }[m[2]]
    return float(m[1] or 1) * unit
