"""Trip legs between consecutive stops, and route candidates by a pluggable strategy."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import TRIP_CHAIN, InputError, validate
from ..functions.geo import haversine_m

LEG = ("user_id", "from_seq", "to_seq", "depart_ts", "arrive_ts", "from_lat", "from_lon", "to_lat", "to_lon", "displacement_m")
CANDIDATE = ("user_id", "from_seq", "to_seq", "strategy", "route_status", "route_length_m")


def build_trip_legs(chain: DataFrame) -> DataFrame:
    """A leg from every stop to the user's next."""
    validate(chain, TRIP_CHAIN)
    order = Window.partitionBy("user_id").orderBy("seq_idx")
    nxt = lambda c: F.lead(c).over(order)
    rows = chain.select(
        "user_id", F.col("seq_idx").alias("from_seq"), nxt("seq_idx").alias("to_seq"), F.col("end_ts").alias("depart_ts"), nxt("start_ts").alias("arrive_ts"),
        F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), nxt("lat").alias("to_lat"), nxt("lon").alias("to_lon"),
    ).where("to_seq is not null")
    return rows.withColumn("displacement_m", haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))).select(*LEG)


def infer_route_candidates(
    legs: DataFrame, network_graph: Any = None, strategy: str | None = None, strategy_fn: Callable[[DataFrame, Any], DataFrame] | None = None
) -> DataFrame:
    """Route candidates of legs. ``strategy_fn(legs, network_graph)`` returns them; without one every leg is unresolved."""
    name = strategy or "unspecified"
    if strategy_fn is None:
        status = {"strategy": F.lit(name), "route_status": F.lit("unresolved_strategy"), "route_length_m": F.lit(None).cast("double")}
        return legs.select("user_id", "from_seq", "to_seq").withColumns(status).select(*CANDIDATE)
    found = strategy_fn(legs, network_graph)
    if not isinstance(found, DataFrame):
        raise TypeError("a strategy returns a DataFrame")
    if "strategy" not in found.columns:
        found = found.withColumn("strategy", F.lit(name))
    missing = [c for c in CANDIDATE if c not in found.columns]
    if missing:
        raise InputError(f"route candidates: missing columns {missing}")
    return found
