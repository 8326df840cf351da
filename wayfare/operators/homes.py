"""Home locations from night-time pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import in_window, local_clock, micros, resolve_tz
from ..functions.geo import Utm


def infer_homes(
    pings: DataFrame, nighttime_start: int = 20, nighttime_end: int = 7, grid_cell_size: float = 50.0, min_nights: int = 14,
    min_stay_time: float = 0.0, crs_meters: int = 26911, local_tz: str | None = None, user: str = "user_id",
    time: str = "datetime", lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """The home cell of every user: of the grid cells with night pings, that with the longest span between its first and
    last night ping; ties by nights, then by cell. It must have ``min_nights`` nights and ``min_stay_time`` seconds; a
    weaker cell does not take its place. One shuffle on (user, cell) with partial aggregation, one on the user."""
    zone = resolve_tz(pings, time, local_tz)
    kind = dict(pings.dtypes)[time]
    clock = local_clock(F.col(time), kind, zone)
    utm = Utm(crs_meters)
    east, north = utm.forward(F.col(lat).cast("double"), F.col(lon).cast("double"))
    snap = lambda v: F.rint(v / grid_cell_size) * grid_cell_size
    night = F.date_sub(F.to_date(clock - F.expr(f"INTERVAL {int(nighttime_end)} HOURS")), 0)
    rows = pings.select(
        F.col(user).alias("ID"), micros(F.try_to_timestamp(F.col(time)) if kind == "string" else F.col(time)).alias("us"),
        F.hour(clock).alias("h"), night.alias("night"), snap(east).alias("utm_x"), snap(north).alias("utm_y")
    )
    rows = rows.where(
        F.col("ID").isNotNull() & in_window(F.col("h"), nighttime_start, nighttime_end) & F.col("utm_x").isNotNull() & ~F.isnan("utm_x")
    )
    cells = rows.groupBy("ID", "utm_x", "utm_y").agg(
        ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("stay_time"), F.count_distinct("night").alias("num_nights")
    )
    best = Window.partitionBy("ID").orderBy(F.desc("stay_time"), F.desc("num_nights"), "utm_x", "utm_y")
    won = cells.withColumn("_r", F.row_number().over(best)).where(
        f"_r = 1 and num_nights >= {int(min_nights)} and stay_time >= {float(min_stay_time)}"
    )
    home_lat, home_lon = utm.inverse(F.col("utm_x"), F.col("utm_y"))
    return won.select("ID", "utm_x", "utm_y", "num_nights", "stay_time", home_lon.alias("home_lon_4326"), home_lat.alias("home_lat_4326"))
