"""Behaviour categories of residents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code, group number, name.
CATEGORIES = [
    ("SELE", 1, "Self-Evacuee Leaving Early"),
    ("PERE", 2, "Partially-compliant Evacuee (Early Returner)"),
    ("FEUW", 3, "Fully-compliant Evacuee Under Warning"),
    ("FEUO", 4, "Fully-compliant Evacuee Under Order"),
    ("SEFN", 5, "Shadow Evacuee From Nearby"),
    ("NER", 6, "Non-Evacuee Resident"),
    ("UR", 7, "Uncategorized Resident"),
]
EVACUATED = ["SELE", "PERE", "FEUO", "FEUW", "SEFN"]


def record_category(
    departure: Column, return_: Column, order_start: Column, zone: Column, order_end: Column | None = None, fire_start: Column | None = None
) -> Column:
    """The category of a record as one CASE expression. Comparisons with null do not hold, as in SQL."""
    null = F.lit(None).cast("timestamp")
    fire_start = null if fire_start is None else fire_start
    order_end = null if order_end is None else order_end
    order = F.when(order_start.isNull() & zone.isin("Buffer", "Outside"), fire_start).otherwise(order_start)
    early = F.when(return_ < order, "NER").when(departure < fire_start, "UR").otherwise("SELE")
    late = F.when(zone == "Buffer", "SEFN").when(return_ <= order_end, "PERE").when(zone == "Warning", "FEUW").when(
        zone == "Order", "FEUO"
    ).otherwise("UR")
    return F.when(order.isNull(), "UR").when(departure.isNull(), "NER").when(departure < order, early).otherwise(late)


def classify(
    records: DataFrame, departure: str = "DepartureDate", return_: str = "ReturnDate", order_start: str = "OrderStart",
    zone: str = "ZoneType", order_end: str | None = "OrderEnd", fire_start: str | None = None
) -> DataFrame:
    """Adds Category to records."""
    column = lambda c: F.col(c) if c and c in records.columns else None
    rule = record_category(F.col(departure), F.col(return_), F.col(order_start), F.col(zone), column(order_end), column(fire_start))
    return records.withColumn("Category", rule)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "Category string, GroupId int, Description string")


def summary(records: DataFrame, category: str = "Category", include_empty: bool = True) -> DataFrame:
    """Count, Percentage and Description by category in the order of group numbers; with ``include_empty`` also categories
    without records."""
    counts = records.groupBy(F.col(category).alias("Category")).agg(F.count(F.lit(1)).alias("Count"))
    total = counts.agg(F.sum("Count").alias("total"))
    named = F.broadcast(categories(records.sparkSession)).join(counts, "Category", "left" if include_empty else "inner")  # seven rows
    share = F.round(F.col("Count") / F.col("total") * 100, 2)
    return named.withColumn("Count", F.coalesce("Count", F.lit(0).cast("long"))).join(F.broadcast(total)).select(
        "GroupId", "Category", "Count", F.coalesce(share, F.lit(0.0)).alias("Percentage"), "Description"
    ).orderBy("GroupId")
