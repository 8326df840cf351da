"""Runs of consecutive away days, and the one that belongs to an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Maximal runs of consecutive dates for each key: first_day, last_day, n_days."""
    distinct = days.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("day")).distinct()
    start = F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    return distinct.withColumn("_island", start).groupBy(*keys, "_island").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days")
    ).drop("_island")


def selected_island(runs: DataFrame, keys: list[str], reference: Column | None = None) -> DataFrame:
    """The first run that ends on the reference date or later; the first run at all where the reference is null. Only this
    run is looked at later: if it is too short, a later run does not take its place."""
    if reference is not None:
        runs = runs.where(reference.isNull() | (F.col("last_day") >= reference))
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("first_day"))).where("_r = 1").drop("_r")


def stay_bounds(away: DataFrame, chosen: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Departure (first ``start`` of the run's first day) and return (last ``end`` of its last day)."""
    joined = away.join(chosen, keys)
    return joined.groupBy(*keys, "first_day", "last_day", "n_days").agg(
        F.min(F.when(F.col("day") == F.col("first_day"), start)).alias("departure"),
        F.max(F.when(F.col("day") == F.col("last_day"), end)).alias("return"),
    )


def run_array(days: Column) -> Column:
    """Runs of consecutive dates in a sorted array of (day, first, last): (first_day, last_day, n_days, departure, return)
    in order, departure being the first day's ``first`` and return the last day's ``last``."""

    def step(a: Column, d: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        follows = F.coalesce(F.date_add(last["last_day"], 1) == d["day"], F.lit(False))
        began = F.when(follows, F.struct(last["first_day"].alias("day"), last["n_days"].alias("n"), last["departure"].alias("at")))
        began = F.coalesce(began, F.struct(d["day"].alias("day"), F.lit(0).alias("n"), d["first"].alias("at")))
        run = F.struct(
            began["day"].alias("first_day"), d["day"].alias("last_day"), (began["n"] + 1).alias("n_days"),
            began["at"].alias("departure"), d["last"].alias("return")
        )
        return F.concat(F.when(follows, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a), F.array(run))

    start = F.array().cast("array<struct<first_day:date,last_day:date,n_days:int,departure:timestamp_ntz,return:timestamp_ntz>>")
    return F.aggregate(days, start, step)
