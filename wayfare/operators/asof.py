"""As-of joins of whole tables: each row with the last row of another table at or before its time.

Both tables are put together and sorted by key and time, and the last right row is carried along. A key may hold any share
of the rows: time is cut into buckets, a task sorts a bucket of a key, and what a bucket starts with, the last right row of
the buckets before, comes from one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def as_of(
    left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], right_key: str | None = None, right_time: str | None = None,
    ties: list[str] | None = None, bucket_s: float = 86_400.0, tolerance_s: float | None = None
) -> DataFrame:
    """The rows of ``left`` with ``columns`` of the right row of the same key whose time is the latest at or before theirs;
    of several at that time the greatest by ``ties``. Nulls where there is none, where key or time is null, or where the right
    row is more than ``tolerance_s`` old. A column that left has as well gets the suffix ``_right``."""
    right_key, right_time = right_key or key, right_time or time
    names = {c: f"{c}_right" if c in left.columns else c for c in columns}
    bucket = F.floor(F.col("_t") / int(bucket_s * 1e6))
    kept = F.struct(F.col("_t"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties or [])], F.struct(*columns).alias("v"))
    known = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).withColumn("_t", _micros(right_time))
    given = known.select(F.col(right_key).alias("_k"), "_t", kept.alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    asked = left.withColumn("_t", _micros(time)).select(
        F.col(key).alias("_k"), "_t", F.lit(None).cast(given.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l")
    )
    both = given.unionByName(asked).withColumn("_b", bucket)
    # The right rows of a time come before the left ones; the greatest of them is the last.
    run = Window.partitionBy("_k", "_b").orderBy("_t", F.col("_l").isNotNull(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("_r", ignorenulls=True).over(run)).where("_l is not null")
    ends = given.withColumn("_b", bucket).groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    # A bucket without right rows starts with what the last one before had: both kinds of buckets in one line for a key.
    asked_buckets = asked.withColumn("_b", bucket).select("_k", "_b").distinct()
    line = ends.unionByName(asked_buckets.withColumn("_r", F.lit(None).cast(given.schema["_r"].dataType)))
    line = line.groupBy("_k", "_b").agg(F.max("_r").alias("_r"))  # a row for each key and bucket
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = line.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.last("_r", ignorenulls=True).over(before).alias("_start")).where("_start is not null")
    found = inside.join(starts, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")), "left").withColumn("_f", F.coalesce("_in", "_start"))
    usable = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    if tolerance_s is not None:
        usable &= F.col("_t") - F.col("_f._t") <= int(tolerance_s * 1e6)
    return found.select("_l.*", *[F.when(usable, F.col(f"_f.v.{c}")).alias(names[c]) for c in columns])
