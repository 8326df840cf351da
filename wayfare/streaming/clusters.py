"""Stay clusters over a stream: the batch state machine, with its state in the state store.

Rows go through Python one by one, not as a data frame for each user: most of these would hold a few pings, and cost
more than the clusters. State of a user: the open cluster as sums, not as a list of pings, and its number. Within a micro-batch pings are sorted;
pings older than the open cluster's last one are late and left out. A cluster is closed by a break, or by a timer when the
watermark passes its end by ``max_gap_s``, so a stream that falls silent still closes its clusters. At the end of the
input, ``close_open_clusters`` gives the clusters that are still open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.clustering import ClusterConfig
from ..shipping import ship

EVENTS = "user_id string, event_type string, cluster_id long, event_time timestamp, centroid_lat double, centroid_lon double, start_time timestamp, n_points long, dwell_s double"
#: The same with times in microseconds.
_RAW = EVENTS.replace("timestamp", "long")
_ROW = Row(*[c.split()[0] for c in EVENTS.split(", ")])
STATE = "id long, n long, lat double, lon double, from_us long, to_us long"


class Engine:
    """The state machine of one user; times in microseconds."""

    def __init__(self, config: ClusterConfig, state: tuple | None = None):
        self.config = config
        self.id, self.n, self.lat, self.lon, self.start, self.end = state or (0, 0, 0.0, 0.0, 0, 0)

    def state(self) -> tuple:
        return self.id, self.n, self.lat, self.lon, self.start, self.end

    def _event(self, kind: str, at: int) -> tuple:
        if kind == "cluster_closed":
            return kind, self.id, at, self.lat / self.n, self.lon / self.n, self.start, self.n, (self.end - self.start) / 1e6
        return kind, self.id, at, None, None, None, None, None

    def update(self, at: int, lat: float, lon: float) -> Iterator[tuple]:
        if self.n:
            late = self.config.max_gap_s is not None and (at - self.end) / 1e6 > self.config.max_gap_s
            if not late and distance_m(self.lat / self.n, self.lon / self.n, lat, lon) <= self.config.radius_m:
                self.n, self.lat, self.lon, self.end = self.n + 1, self.lat + lat, self.lon + lon, at
                yield self._event("cluster_updated", at)
                return
            yield from self.flush()
        self.id, self.n, self.lat, self.lon, self.start, self.end = self.id + 1, 1, lat, lon, at, at
        yield self._event("cluster_started", at)

    def flush(self) -> Iterator[tuple]:
        if self.n and (self.end - self.start) / 1e6 >= self.config.min_dwell_s:
            yield self._event("cluster_closed", self.end)
        self.n = 0


def distance_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    from math import atan2, cos, radians, sin, sqrt

    a = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * atan2(sqrt(a), sqrt(1 - a))


class ClusterProcessor(StatefulProcessor):
    def __init__(self, config: ClusterConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _timer(self, engine: Engine) -> int | None:
        gap = self.config.max_gap_s
        return engine.end // 1000 + int(gap * 1000) + 1 if gap is not None and engine.n else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.open.get()
        engine = Engine(self.config, tuple(held) if held else None)
        before = self._timer(engine)
        pings = sorted((r.us, r.latitude, r.longitude) for r in rows if None not in (r.us, r.latitude, r.longitude) and r.latitude == r.latitude and r.longitude == r.longitude)
        for at, lat, lon in pings:
            if not (engine.n and at < engine.end):
                for event in engine.update(at, lat, lon):
                    yield _ROW(key[0], *event)
        self.open.update(engine.state())
        after = self._timer(engine)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if not held:
            return
        engine = Engine(self.config, tuple(held))
        events = list(engine.flush())
        self.open.update(engine.state())
        for event in events:
            yield _ROW(key[0], *event)

    def close(self) -> None:
        pass


def stream_cluster_events(pings: DataFrame, config: ClusterConfig | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Cluster events of a streaming table of pings (user_id, datetime, latitude, longitude). Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    config = config or ClusterConfig()
    ship(pings.sparkSession)
    # The stream's own driver process does not see shipped files: the state machine travels by value.
    for module in (__name__, ClusterConfig.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[module])
    text = F.col("user_id").cast("string").alias("user_id")
    rows = pings.select(text, "datetime", F.col("latitude").cast("double"), F.col("longitude").cast("double")).withWatermark("datetime", watermark)
    rows = rows.withColumn("us", F.unix_micros("datetime"))
    mode = "EventTime" if config.max_gap_s is not None else "None"
    found = rows.groupBy("user_id").transformWithState(ClusterProcessor(config), outputStructType=_RAW, outputMode="Append", timeMode=mode)
    times = {c: F.timestamp_micros(c) for c in ("event_time", "start_time")}
    return found.withColumns(times)


def close_open_clusters(spark: SparkSession, checkpoint: str, config: ClusterConfig | None = None) -> DataFrame:
    """The last cluster of each user, closed at the end of the input: events like those of the stream, read from the state
    that a stopped query left in its checkpoint. Clusters that are too short give none, like in the stream. The state is not
    changed: a stream that goes on from the checkpoint still has these clusters open."""
    config = config or ClusterConfig()
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    rows = held.select(F.col("key").getField(held.schema["key"].dataType[0].name).alias("user_id"), "value.*").where("n > 0")
    rows = rows.withColumn("dwell_s", (F.col("to_us") - F.col("from_us")) / 1e6).where(F.col("dwell_s") >= config.min_dwell_s)
    return rows.select(
        "user_id", F.lit("cluster_closed").alias("event_type"), F.col("id").alias("cluster_id"), F.timestamp_micros("to_us").alias("event_time"),
        (F.col("lat") / F.col("n")).alias("centroid_lat"), (F.col("lon") / F.col("n")).alias("centroid_lon"),
        F.timestamp_micros("from_us").alias("start_time"), F.col("n").alias("n_points"), "dwell_s"
    )
