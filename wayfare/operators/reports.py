"""Aggregate tables behind the usual charts: each is a DataFrame, rendering is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import seconds_between
from ..functions.geo import bing_corner, bing_tile
from ..storage import kept
from .behavior import EVACUATED
from .clustering import duration_s
from .quantiles import with_quantiles
from .trip_chain import first_rows

COMPOSITION_ORDER = ["FEUO", "FEUW", "SELE", "SEFN", "PERE", "NER", "UR"]


def compliance_rate(records: DataFrame, zone_col: str = "ZoneType", category_col: str = "Category") -> DataFrame:
    """Residents, evacuated residents and their share by zone, all doubles; uncategorised residents count in the total."""
    out = records.where(F.col(zone_col).isNotNull()).groupBy(zone_col)
    out = out.agg(
        F.count(F.lit(1)).cast("double").alias("Total_Residents"), F.count_if(F.col(category_col).isin(EVACUATED)).cast("double").alias("Evacuated")
    )
    return out.withColumn("Compliance_Rate", F.col("Evacuated") / F.col("Total_Residents"))


def dedi(records: DataFrame, spatial_unit: str = "ZoneType") -> DataFrame:
    """Compliance of Order residents by unit, its deviation from the plain mean of the units' rates, and the deviation's
    size relative to that mean (0 if the mean is 0)."""
    rates = compliance_rate(records.where("ZoneType = 'Order'"), spatial_unit)
    mean = F.avg("Compliance_Rate").over(Window.partitionBy(F.lit(0)))  # a row for each unit
    out = rates.withColumn("_mean", mean).withColumn("DEDI_Deviation", F.col("Compliance_Rate") - F.col("_mean"))
    return out.withColumn("DEDI", F.when(F.col("_mean") > 0, F.abs("DEDI_Deviation") / F.col("_mean")).otherwise(0.0)).drop("_mean")


def _grid(df: DataFrame, start: str, end: str, freq: str) -> DataFrame:
    step = f"INTERVAL {int(duration_s(freq))} SECONDS"
    return df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(step))).alias("Datetime")
    )


def departure_curve(records: DataFrame, start: str, end: str, freq: str = "1h", zone: str | None = "Order") -> DataFrame:
    """Departures strictly before each point of a time grid (both ends included), and their share of all records of the
    zone. Departures are first counted by grid step, so the join is with one row for each step."""
    rows = records.where(F.col("ZoneType") == zone) if zone else records
    step = int(duration_s(freq))
    us = lambda c: F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz")).cast("timestamp"))
    after = (us(F.col("DepartureDate")) - us(F.lit(start).cast("timestamp_ntz"))) / F.lit(step * 1e6)
    # A departure counts from the first grid point after it.
    counted = rows.select((F.floor(after) + 1).cast("long").alias("k"), F.lit(1).alias("one")).groupBy("k").agg(F.sum("one").alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    steps = _grid(records, start, end, freq).withColumn(
        "k", ((us(F.col("Datetime")) - us(F.lit(start).cast("timestamp_ntz"))) / F.lit(step * 1e6)).cast("long")
    )
    early = counted.where("k is not null").withColumn("k", F.greatest("k", F.lit(0))).groupBy("k").agg(F.sum("n").alias("n"))
    joined = steps.join(early, "k", "left").withColumn(
        "Cumulative_Count", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("k")), F.lit(0)).cast("long")
    )
    share = F.when(F.col("total") > 0, F.col("Cumulative_Count") / F.col("total") * 100).otherwise(0.0)
    return joined.join(F.broadcast(total)).select("Datetime", "Cumulative_Count", share.alias("Cumulative_Pct"))


def positional_share(rows: DataFrame, value: str, width: float, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the share of rows of each key up to and with each row, in the order of ``value``, then ``order``.

    Rows are ranked within bins of ``width``; the rows in bins before come from the bins' counts. So no task sorts more
    than a bin, and only the counts (a row for each bin) meet in one."""
    binned = rows.withColumn("_bin", F.floor(F.col(value) / width))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_bin").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(part).alias("_all")
    )
    same = F.col("_bin") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value, *order))
    out = binned.join(counts, same).withColumn(name, (F.col("_before") + rank) / F.col("_all"))
    return out.drop("_bin", "_b", "_before", "_all", *[f"_key_{k}" for k in keys])


def departure_hours_curve(metrics: DataFrame, reference: str, group: str | None = None, hours: float = 72.0) -> DataFrame:
    """Running share of residents who left, by hours since the reference, within 0 to ``hours``; Category NER is left out."""
    h = seconds_between(F.lit(reference).cast("timestamp_ntz"), F.col("DepartureDate").cast("timestamp_ntz")) / 3600.0
    keys = [group] if group else []
    rows = metrics.where("Category <> 'NER'").select("ID", *keys, h.alias("hours")).where(F.col("hours").between(0, hours))
    return positional_share(rows, "hours", 1 / 60, keys, ["ID"], "pct").withColumn("pct", F.col("pct") * 100)


def departures_by_hour(metrics: DataFrame) -> DataFrame:
    """Departures of each hour and their running total."""
    counts = metrics.where("DepartureDate is not null").groupBy(
        F.date_trunc("hour", F.col("DepartureDate")).cast("timestamp_ntz").alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("hour")))


def nights(spans: DataFrame, keys: list[str], from_hour: int = 20, to_hour: int = 7, hours: float = 48.0) -> DataFrame:
    """Night stretches between the times ``start`` and ``end`` of each row, as hours since the start, clipped at ``hours``."""
    start, end = F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz")
    days = spans.select(*keys, start.alias("_s"), F.explode(F.sequence(F.date_sub(F.to_date(start), 1), F.to_date(end))).alias("d"))
    at = lambda d, h: d.cast("timestamp_ntz") + F.expr(f"INTERVAL {h} HOURS")
    since = lambda t: seconds_between(F.col("_s"), t) / 3600.0
    rows = days.select(
        *keys, F.greatest(since(at(F.col("d"), from_hour)), F.lit(0.0)).alias("from_hour"),
        F.least(since(at(F.date_add("d", 1), to_hour)), F.lit(float(hours))).alias("to_hour")
    )
    return rows.where("from_hour < to_hour")


def night_intervals(start: str, end: str, spark, from_hour: int = 20, to_hour: int = 7, hours: float = 48.0) -> DataFrame:
    """The same between two times."""
    return nights(spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end")), [], from_hour, to_hour, hours)


def alert_offsets(zones: DataFrame, reference: str) -> DataFrame:
    """Hours from the reference to the first warning and the first order."""
    first = lambda kind: F.min(F.when(F.col("most_extreme_status").contains(kind), F.col("datetime").try_cast("timestamp_ntz")))
    rows = zones.agg(first("Evacuation Warning").alias("WarningStart"), first("Evacuation Order").alias("OrderStart"))
    since = lambda c: seconds_between(F.lit(reference).cast("timestamp_ntz"), F.col(c)) / 3600.0
    return rows.select(since("WarningStart").alias("warning_hours"), since("OrderStart").alias("order_hours"))


def composition(records: DataFrame, group: str, exclude_ner: bool = False) -> DataFrame:
    """Rows of each (group, Category) and their share of the group's distinct residents."""
    rows = records.where("Category <> 'NER'") if exclude_ner else records
    rows = rows.where(F.col(group).isNotNull() & F.col("Category").isNotNull())
    totals = rows.groupBy(group).agg(F.count_distinct("ID").alias("total"))
    counts = rows.groupBy(group, "Category").agg(F.count(F.lit(1)).alias("count")).join(totals, group)
    pct = F.col("count") / F.col("total") * 100
    return counts.withColumn("pct", pct).withColumn("label", F.format_string("%d (%.1f%%)", "count", pct))


def composition_table(records: DataFrame, group: str, exclude_ner: bool = False) -> DataFrame:
    """The composition as one row for each group, a column of percentages for each category."""
    return composition(records, group, exclude_ner).groupBy(group).pivot("Category", COMPOSITION_ORDER).agg(F.first("pct")).na.fill(0.0)


def composition_panels(records: DataFrame, group: str) -> DataFrame:
    """Both panels: all residents, and evacuees only."""
    return composition(records, group).withColumn("panel", F.lit("all")).unionByName(
        composition(records, group, True).withColumn("panel", F.lit("evacuees_only"))
    )


def delay_tiles(metrics: DataFrame, level: int = 14) -> DataFrame:
    """Total delay and residents for each map tile with a delay, and the tile's corners."""
    x, y = bing_tile(F.col("home_lat_4326"), F.col("home_lon_4326"), level)
    tiles = metrics.where("DelayHours > 0").groupBy(x.alias("grid_x"), y.alias("grid_y")).agg(
        F.sum("DelayHours").alias("total_delay"), F.count("ID").alias("user_count")
    )
    north, west = bing_corner(F.col("grid_x"), F.col("grid_y"), level)
    south, east = bing_corner(F.col("grid_x") + 1, F.col("grid_y") + 1, level)
    return tiles.withColumns({"lat_min": south, "lon_min": west, "lat_max": north, "lon_max": east})


def box_stats(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Number, mean, quartiles, 95th percentile and extremes of a value."""
    out = with_quantiles(
        rows, value, keys, [0.25, 0.5, 0.75, 0.95], F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return out.select(
        *keys, "n", "mean", "min", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"),
        F.col("p")[3].alias("p95"), "max"
    )


def delay_distribution(metrics: DataFrame, group: str = "Category") -> DataFrame:
    return box_stats(metrics.where("DelayHours > 0"), "DelayHours", [group])


def delay_summary(metrics: DataFrame, delay: str = "DelayHours") -> DataFrame:
    out = with_quantiles(metrics, delay, [], [0.5], F.avg(delay).alias("mean"), F.count_if(F.col(delay) < 0).alias("n_negative"))
    return out.select("mean", F.col("p")[0].alias("median"), "n_negative")


def compliance_by_region(records: DataFrame, region: str, fire: str | None = None, min_total: int = 10) -> DataFrame:
    keys = [region, *([fire] if fire else [])]
    out = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("Total"), F.count_if(F.col("Category").isin(EVACUATED)).alias("Evacuated"))
    return out.where(F.col("Total") >= min_total).withColumn("Rate", F.col("Evacuated") / F.col("Total") * 100)


def temporal_heatmap(metrics: DataFrame, time: str = "DepartureDate") -> DataFrame:
    """Departures by date and hour: 24 columns, only dates with departures."""
    rows = metrics.where(F.col(time).isNotNull()).select(F.to_date(time).alias("date"), F.hour(time).alias("hour"))
    return rows.groupBy("date").pivot("hour", list(range(24))).count().na.fill(0)


def temporal_heatmap_long(metrics: DataFrame, start: str, days: int = 7, time: str = "DepartureDate") -> DataFrame:
    """Departures by day number and hour within some days from a start."""
    h = seconds_between(F.lit(start).cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz")) / 3600.0
    return metrics.withColumn("_h", h).where(F.col("_h").between(0, 24 * days)).groupBy(
        F.to_date(time).alias("date"), F.hour(time).alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))


def return_hours(metrics: DataFrame, most: float = 720.0) -> DataFrame:
    """Hours from the reference (fire start, else first order, else first return) to each return within 0 to ``most``."""
    firsts = metrics.agg(F.min("OrderStart").alias("_o"), F.min("ReturnDate").alias("_r"))
    has = "fire_start" in metrics.columns
    rows = metrics.join(F.broadcast(firsts))
    reference = F.coalesce(
        *([F.col("fire_start").cast("timestamp_ntz")] if has else []), F.col("_o").cast("timestamp_ntz"), F.col("_r").cast("timestamp_ntz")
    )
    rows = rows.where(F.col("Category").isin(EVACUATED)).withColumn(
        "return_hours", seconds_between(reference, F.col("ReturnDate").cast("timestamp_ntz")) / 3600.0
    )
    return rows.where(F.col("return_hours").between(0, most)).drop("_o", "_r")


def return_timeline(metrics: DataFrame) -> DataFrame:
    return box_stats(return_hours(metrics), "return_hours", ["Category"])


def distance_histogram(
    destinations: DataFrame, max_km: float = 300.0, bin_width: float = 10.0, group: str | None = None, distance: str = "eu_distance_km"
) -> DataFrame:
    """Counts by distance bin; the last bin includes its right edge, distances beyond are left out."""
    keys, last = ([group] if group else []), int(math.ceil(max_km / bin_width)) - 1
    rows = destinations.where(F.col(distance).between(0, (last + 1) * bin_width))
    at = F.least(F.floor(F.col(distance) / bin_width), F.lit(last)).cast("long")
    return rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"from_km": F.col("bin") * bin_width, "to_km": (F.col("bin") + 1) * bin_width}
    )


def distance_ecdf(destinations: DataFrame, group: str | None = None, distance: str = "eu_distance_km") -> DataFrame:
    """Positional empirical distribution: the k-th smallest of n distances has k / n."""
    keys = [group] if group else []
    rows = destinations.where(F.col(distance).isNotNull()).select(*keys, F.col(distance).alias("distance"), "ID", "dest_order")
    return positional_share(rows, "distance", 0.1, keys, ["ID", "dest_order"], "ecdf").drop("ID", "dest_order")


def distance_decay(
    destinations: DataFrame, max_km: float = 300.0, step: float = 5.0, group: str | None = None, distance: str = "eu_distance_km"
) -> DataFrame:
    """Share of destinations at each threshold or farther. Distances are counted by step first."""
    keys = [group] if group else []
    rows = destinations.where(F.col(distance).isNotNull())
    at = F.least(F.floor(F.col(distance) / step), F.lit(int(max_km / step))).cast("long")
    counts = rows.groupBy(*keys, at.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else counts.agg(F.sum("n").alias("total"))
    steps = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(max_km / step)).cast("long"))).alias("k"))
    joined = steps.join(counts, [*keys, "k"], "left")
    up = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("k"))
    return joined.withColumn("share", F.coalesce(F.sum("n").over(up), F.lit(0)) / F.col("total")).select(
        *keys, (F.col("k") * step).alias("threshold_km"), "share"
    )


def destination_types(destinations: DataFrame, threshold_km: float | None = None, mode: str = "all") -> DataFrame:
    """Counts and shares of destination types: all, up to a distance ('leq') or beyond it ('gt')."""
    if mode not in ("all", "leq", "gt"):
        raise ValueError(f"unknown mode: {mode}")
    rows = destinations.where("dest_type is not null")
    if mode != "all":
        rows = rows.where(F.col("eu_distance_km") <= threshold_km if mode == "leq" else F.col("eu_distance_km") > threshold_km)
    counts = rows.groupBy("dest_type").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))) * 100, 1))


def near_far_types(destinations: DataFrame, threshold_km: float = 30.0) -> DataFrame:
    """Shares of each type among near and far destinations; types of either kind appear in both."""
    rows = destinations.where("dest_type is not null")
    near = F.col("eu_distance_km") <= threshold_km
    far = F.col("eu_distance_km") > threshold_km
    counts = rows.groupBy("dest_type").agg(F.count_if(near).alias("a"), F.count_if(far).alias("b"))
    every = Window.partitionBy(F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100, F.sum(c).over(every)), F.lit(0.0))
    return counts.select("dest_type", share("a").alias("near_pct"), share("b").alias("far_pct"))


def group_type_matrix(destinations: DataFrame, group: str, value: str = "pct") -> DataFrame:
    """For each group and type, the share of the group's destinations, or the median distance (0 where there is none)."""
    rows = destinations.where(F.col(group).isNotNull() & F.col("dest_type").isNotNull())
    n = F.count(F.lit(1)).alias("n")
    if value == "pct":
        cells = rows.groupBy(group, "dest_type").agg(n)
    else:
        cells = with_quantiles(rows, "eu_distance_km", [group, "dest_type"], [0.5], n).withColumn("m", F.col("p")[0])
    pct = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)) * 100, 1)
    cells = cells.withColumn("v", pct if value == "pct" else F.round("m", 1)).select(group, "dest_type", "v")
    every = cells.select(group).distinct().join(F.broadcast(cells.select("dest_type").distinct()))  # at most nine types
    return every.join(cells, [group, "dest_type"], "left").select(group, "dest_type", F.coalesce("v", F.lit(0.0)).alias("value"))


def evacuee_groups(destinations: DataFrame, group: str) -> DataFrame:
    """Residents by group with share, and mean and median number of destinations."""
    one = first_rows(
        destinations.select("ID", group, "dest_order"), ["ID"], [F.col("dest_order"), F.col(group)]
    ).groupBy(group).agg(F.count(F.lit(1)).alias("residents"))
    trips = destinations.groupBy("ID", group).agg(F.count(F.lit(1)).alias("n"))
    each = with_quantiles(trips, "n", [group], [0.5], F.avg("n").alias("mean_destinations"))
    each = each.select(group, "mean_destinations", F.col("p")[0].alias("median_destinations"))
    return one.withColumn("pct", F.col("residents") / F.sum("residents").over(Window.partitionBy(F.lit(0))) * 100).join(each, group, "left")


def destination_counts(destinations: DataFrame) -> DataFrame:
    return destinations.groupBy("ID").agg(F.count(F.lit(1)).alias("n_destinations")).groupBy("n_destinations").agg(
        F.count(F.lit(1)).alias("residents")
    )


def daily_distances(destinations: DataFrame, group: str | None = None) -> DataFrame:
    keys = ["dest_date", *([group] if group else [])]
    out = with_quantiles(destinations, "eu_distance_km", keys, [0.5], F.count(F.lit(1)).alias("n"), F.avg("eu_distance_km").alias("mean_km"))
    return out.select(*keys, F.col("p")[0].alias("median_km"), "n", "mean_km")


def trip_duration_by_type(destinations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Days away by the type of a resident's first destination."""
    first = first_rows(destinations, ["ID"], [F.col("dest_order")]).select("ID", "dest_type")
    days = seconds_between(F.col("DepartureDate").cast("timestamp_ntz"), F.col("ReturnDate").cast("timestamp_ntz")) / 86400.0
    rows = first.join(metrics.select("ID", days.alias("days_away")), "ID").where("days_away > 0 and dest_type is not null")
    return box_stats(rows, "days_away", ["dest_type"])


def crosstab(records: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts by two columns with margins; null marks are named 'All'."""
    cube = records.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).cube(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce(rows, F.lit("All")).alias(rows), F.coalesce(columns, F.lit("All")).alias(columns), "n")


def od_pairs(destinations: DataFrame, homes: DataFrame, max_trips: int = 500, seed: int = 42) -> DataFrame:
    """Home-destination lines: at most ``max_trips``, chosen by a hash, the same in every run."""
    known = first_rows(
        homes.select("ID", "home_lat_4326", "home_lon_4326"), ["ID"], [F.col("home_lat_4326").asc_nulls_last(), F.col("home_lon_4326").asc_nulls_last()]
    )
    rows = destinations.join(known, "ID").select("ID", "dest_order", "home_lat_4326", "home_lon_4326", "dest_lat", "dest_lon").na.drop()
    mixed = F.md5(F.concat_ws("/", F.col("ID").cast("string"), F.col("dest_order").cast("string"), F.lit(str(seed))))
    return rows.orderBy(mixed, "ID", "dest_order").limit(max_trips)


def od_extent(pairs: DataFrame, zoom_percentile: float = 99.5) -> DataFrame:
    """Map extent of O-D lines: percentiles of all end points, padded by 12 percent or 0.2 degrees."""
    points = pairs.select(F.col("home_lat_4326").alias("lat"), F.col("home_lon_4326").alias("lon")).unionByName(
        pairs.select(F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon"))
    )
    hi, lo = zoom_percentile / 100, 1 - zoom_percentile / 100
    of = lambda axis, c: F.struct(F.lit(axis).alias("axis"), F.col(c).alias("v"))
    both = points.select(F.explode(F.array(of("a", "lat"), of("o", "lon"))).alias("e"))
    axes = with_quantiles(both.select("e.*"), "v", ["axis"], [lo, hi])
    box = axes.agg(*[F.max(F.when(F.col("axis") == c, F.col("p"))).alias(c) for c in ("a", "o")])
    pad = lambda c: F.greatest(F.lit(0.2), (F.col(c)[1] - F.col(c)[0]) * 0.12)
    return box.select(
        (F.col("a")[0] - pad("a")).alias("lat_min"), (F.col("a")[1] + pad("a")).alias("lat_max"),
        (F.col("o")[0] - pad("o")).alias("lon_min"), (F.col("o")[1] + pad("o")).alias("lon_max")
    )


def _bin_of(v: Column, edges: list[float]) -> Column:
    """The number of edges below a value, by a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(v <= edges[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(edges))


def ks_statistics(rows: DataFrame, group: str, value: str = "eu_distance_km", bins: int = 128) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of every pair of groups with two values or more each.

    One pass counts distinct values by group; they fall into bins of about equal numbers of values. Running shares at the bins'
    borders bound a pair's statistic from below, and the gap within each bin from above; only the bins that can raise it, and
    in which both groups have values, are looked at value by value. So a pair takes a few bins' values, not all of both
    groups; a row for each pair of groups is the result's size. A task sorts a pair's values of one bin."""
    v = F.col(value).cast("double")
    known = rows.where(F.col(group).isNotNull() & v.isNotNull()).select(F.col(group).alias("g"), v.alias("v"))
    counts = kept(known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), "ks")
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n")).where("n >= 2")
    shares = [k / bins for k in range(1, bins)]
    edges = counts.agg(F.percentile_approx("v", F.array(*[F.lit(q) for q in shares]), 10 * bins)).first()[0] or []
    edges = sorted(set(edges))
    counts = counts.withColumn("bin", _bin_of(F.col("v"), edges))
    held = counts.groupBy("g", "bin").agg(F.sum("c").alias("c")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(len(edges)))
    more = lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.coalesce(F.try_element_at("m", b), F.lit(0))))
    so_far = F.aggregate(every, F.array(F.lit(0).cast("long")), more)
    groups = sizes.join(held, "g").select("g", "n", so_far.alias("cum"))  # a row of ``bins`` numbers for each group
    first, second = (groups.select(F.col("g").alias(f"group_{k}"), F.col("n").alias(f"n_{k}"), F.col("cum").alias(f"cum_{k}")) for k in "ab")
    pairs = first.join(second, F.col("group_a") < F.col("group_b"))
    at = lambda k, b: F.get(F.col(f"cum_{k}"), b) / F.col(f"n_{k}")
    pairs = pairs.withColumn("least", F.array_max(F.transform(every, lambda b: F.abs(at("a", b + 1) - at("b", b + 1)))))
    grows = lambda k, b: F.get(F.col(f"cum_{k}"), b + 1) > F.get(F.col(f"cum_{k}"), b)
    most = lambda b: F.greatest(at("a", b + 1) - at("b", b), at("b", b + 1) - at("a", b))
    pair = ["group_a", "group_b", "n_a", "n_b"]
    wanted = F.filter(every, lambda b: grows("a", b) & grows("b", b) & (most(b) > F.col("least")))
    open_bins = pairs.select(*pair, "cum_a", "cum_b", F.explode(wanted).alias("bin"))
    open_bins = open_bins.select(*pair, "bin", *[F.get(f"cum_{k}", F.col("bin")).alias(f"before_{k}") for k in "ab"])

    def side(key: str, a: int, b: int) -> DataFrame:
        own = counts.select(F.col("g").alias(key), "bin", "v", (F.col("c") * a).alias("c_a"), (F.col("c") * b).alias("c_b"))
        return open_bins.join(own, [key, "bin"]).select(*pair, "bin", "before_a", "before_b", "v", "c_a", "c_b")

    both = side("group_a", 1, 0).unionByName(side("group_b", 0, 1))
    both = both.groupBy(*pair, "bin", "before_a", "before_b", "v").agg(F.sum("c_a").alias("c_a"), F.sum("c_b").alias("c_b"))
    run = Window.partitionBy("group_a", "group_b", "bin").orderBy("v")
    share = [(F.col(f"before_{k}") + F.sum(f"c_{k}").over(run)) / F.col(f"n_{k}") for k in "ab"]
    inner = both.withColumn("gap", F.abs(share[0] - share[1])).groupBy("group_a", "group_b").agg(F.max("gap").alias("gap"))
    return pairs.join(inner, ["group_a", "group_b"], "left").select(*pair, F.greatest("least", F.coalesce("gap", F.lit(0.0))).alias("d"))


#: The larger group's rows up to which p-values are exact.
EXACT_KS = 10_000


def _share_of_paths(limit: int, n: int, m: int) -> float:
    """The share of lattice paths from (0, 0) to (n, m) that stay inside |i * m - j * n| < limit, one diagonal after
    another: cells of a diagonal do not depend on each other."""
    share, low = np.ones(1), 0  # cells (i, s - i) of diagonal s, from i = low
    for s in range(1, n + m + 1):
        first, last = max(0, s - m), min(n, s)
        i = np.arange(first, last + 1)
        padded = np.concatenate([[0.0], share, [0.0]])  # at place i - low + 1
        from_left = padded[np.clip(i - 1 - low + 1, 0, len(share) + 1)]
        from_below = padded[np.clip(i - low + 1, 0, len(share) + 1)]
        share = np.where(np.abs(i * m - (s - i) * n) < limit, (from_left * i + from_below * (s - i)) / s, 0.0)
        low = first
    return float(share[-1])


def ks_p_value(d: float, n: int, m: int, method: str = "auto") -> float:
    """Two-sided p-value: exact by counting lattice paths while the larger group has at most ``EXACT_KS`` rows, else (or
    with 'asymptotic') by the limiting series."""
    if method != "asymptotic" and max(n, m) <= EXACT_KS:
        limit = round(d * n * m)
        return 1.0 if limit == 0 else min(1.0, max(0.0, 1.0 - _share_of_paths(limit, n, m)))
    z = d * math.sqrt(n * m / (n + m))
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, total)) if z > 0.2 else 1.0


def ks_test(rows: DataFrame, group: str, value: str = "eu_distance_km", method: str = "auto") -> DataFrame:
    """``ks_statistics`` with p-values, a flag below 0.05 and stars; a row for each pair of groups."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [ks_p_value(d, int(n), int(m), method) for d, n, m in zip(b["d"], b["n_a"], b["n_b"], strict=True)]
            stars = ["***" if x < 0.001 else "**" if x < 0.01 else "*" if x < 0.05 else "" for x in p]
            found = {"statistic": b["d"].round(4), "p_value": [round(x, 6) for x in p], "significant": [x < 0.05 for x in p], "stars": stars}
            yield pd.DataFrame({"group_a": b["group_a"], "group_b": b["group_b"], **found, "n_a": b["n_a"], "n_b": b["n_b"]})

    from ..shipping import ship

    ship(rows.sparkSession)
    schema = "group_a string, group_b string, statistic double, p_value double, significant boolean, stars string, n_a long, n_b long"
    return ks_statistics(rows, group, value).mapInPandas(add, schema)


def hours_between(a: Column, b: Column) -> Column:
    return seconds_between(a, b) / 3600.0
