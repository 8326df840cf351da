"""Exact percentiles of groups of any size.

Spark's ``percentile`` holds all distinct values of a group in one buffer. Here a group's ranks are found by counts: its
range is cut into ``BINS`` bins, and of the bins only those that hold a wanted rank go on, each with the range of its own
values. After two or three passes what is left is a bin of equal values, or one of at most ``BIN`` rows, which is sorted. No
task ever holds more than a bin, and every pass after the first reads only the rows of wanted bins. Groups of at most
``SMALL`` rows take the built-in function; results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept

SMALL, BINS, BIN = 100_000, 1024, 50_000
#: Bins that are broadcast to the rows, at most: some 10 MB.
BROADCAST = 100_000


def _value(value: str | Column) -> Column:
    """A value as double; NaN is none."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(v), v)


def with_quantiles(
    rows: DataFrame, value: str | Column, keys: list[str], shares: list[float], *others: Column, small: int | None = None, most: int | None = None
) -> DataFrame:
    """Keys, the ``others`` (aggregates), and ``p``: an array with the percentile of each share, between neighbours by
    linear interpolation; null without values. Null keys are a group. ``small``, ``most``: other bounds than ``SMALL`` rows
    of a group and ``BIN`` rows of a bin."""
    largest = rows.groupBy(*keys).agg(F.count(_value(value)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= (SMALL if small is None else small):
        return rows.groupBy(*keys).agg(*others, F.percentile(_value(value), F.array(*[F.lit(q) for q in shares])).alias("p"))
    g = F.struct(*keys).alias("_g") if keys else F.lit(0).alias("_g")
    found = _ranked(rows.select(g, _value(value).alias("v")).where("v is not null"), shares, most or BIN)
    if others:
        base = rows.groupBy(*keys).agg(*others)
    else:
        base = rows.select(*keys).distinct() if keys else rows.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    base = base.withColumn("_g", g)
    return base.join(found, "_g", "left").drop("_g")


def _positions(shares: list[float]) -> Column:
    """The ranks (from 0) next to each share's position among n values."""
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in shares]
    return F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))


def _bin(v: Column) -> Column:
    """The bin of a value between lo and hi; both ends differ, whatever the range, so every pass parts some values."""
    part = F.nanvl(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("double"), F.lit(BINS / 2))
    return F.when(v == F.col("lo"), 0).when(v == F.col("hi"), BINS - 1).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(BINS - 1.0))).cast("int")


def _ranked(rows: DataFrame, shares: list[float], most: int) -> DataFrame:
    """Rows (_g, v) to (_g, p)."""
    groups = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    groups = kept(groups.withColumn("ranks", _positions(shares)), "quantile-groups")
    ranges = groups.select("_g", F.lit("").alias("t"), "lo", "hi", F.lit(0).cast("long").alias("before"), "ranks", F.col("n").alias("c"))
    live, known = rows.select("_g", F.lit("").alias("t"), "v"), []
    while True:
        flat, wide = ranges.where("lo = hi"), ranges.where("lo < hi")
        known.append(flat.select("_g", F.explode("ranks").alias("k"), F.col("lo").alias("v")))
        left = wide.agg(F.max("c"), F.count(F.lit(1))).first()
        small = F.broadcast if left[1] <= BROADCAST else lambda df: df
        # The first pass has a range for each group; a group may be any share of the rows, so they are not dealt by it.
        held = live.join(small(wide.select("_g", "t", "lo", "hi", "before", "ranks")), ["_g", "t"])
        if (left[0] or 0) <= most:
            own = F.col("before") + F.row_number().over(Window.partitionBy("_g", "t").orderBy("v")) - 1
            known.append(held.withColumn("k", own).where(F.array_contains("ranks", F.col("k"))).select("_g", "k", "v"))
            break
        held = held.withColumn("bin", _bin(F.col("v")))
        bins = held.groupBy("_g", "t", "bin").agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("before").alias("b"), F.first("ranks").alias("ranks")
        )
        earlier = Window.partitionBy("_g", "t").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = bins.withColumn("before", F.col("b") + F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        bins = bins.withColumn("ranks", F.filter("ranks", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("c")))).where(F.size("ranks") > 0)
        chosen = kept(bins.withColumn("next", F.concat_ws(".", "t", F.col("bin").cast("string"))), "quantile-bins")
        names = chosen.where("lo < hi").select("_g", "t", "bin", "next")
        live = kept(held.select("_g", "t", "bin", "v").join(small(names), ["_g", "t", "bin"]).select("_g", F.col("next").alias("t"), "v"), "quantile-rows")
        ranges = chosen.select("_g", F.col("next").alias("t"), "lo", "hi", "before", "ranks", "c")
    values = known[0]
    for more in known[1:]:
        values = values.unionByName(more)
    maps = values.groupBy("_g").agg(F.map_from_entries(F.collect_set(F.struct("k", "v"))).alias("m"))

    def between(q: float) -> Column:
        at = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.try_element_at("m", low), F.try_element_at("m", high)
        return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)

    return groups.select("_g", "n").join(maps, "_g").select("_g", F.array(*[between(q) for q in shares]).alias("p"))
