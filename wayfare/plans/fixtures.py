"""Mobility inputs derived from the driver's tables, as SQL that Spark and DuckDB read alike.

``{events}`` stands for a table: Spark binds a DataFrame, the oracle puts the table's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import rectangle
from ..operators.clustering import ClusterConfig

PINGS = """SELECT user_id AS ID, event_id, ts AS datetime,
  34e0 + (user_id % 50) * 1e-2 + CASE WHEN day(ts) BETWEEN 8 AND 8 + user_id % 5 THEN 5e-2 * (1 + user_id % 3)
    ELSE 0e0 END + (event_id % 5) * 1e-4 AS latitude,
  -118.5e0 + (user_id % 40) * 1e-2 + CASE WHEN day(ts) BETWEEN 8 AND 8 + user_id % 5 THEN 5e-2 * (1 + user_id % 3)
    ELSE 0e0 END + (event_id % 5) * 1e-4 AS longitude
FROM {events}"""

HOMES = """SELECT DISTINCT user_id AS ID, 34e0 + (user_id % 50) * 1e-2 AS home_lat_4326, -118.5e0 + (user_id % 40) * 1e-2 AS home_lon_4326 FROM {events}"""

ZONES = """SELECT * FROM (VALUES
 ('z1', 'Evacuation Order', 'east fire', '2024-01-08 00:00:00', -118.505e0, 33.995e0, -118.395e0, 34.155e0),
 ('z2', 'Evacuation Warning', 'east fire', '2024-01-08 06:00:00', -118.395e0, 34.095e0, -118.295e0, 34.305e0),
 ('z3', 'Evacuation Order', 'west fire', '2024-01-08 12:00:00', -118.205e0, 34.295e0, -118.105e0, 34.455e0),
 ('z4', 'Normal', 'west fire', '2024-01-08 18:00:00', -118.505e0, 34.395e0, -118.455e0, 34.455e0)
) AS t(zoneId, most_extreme_status, incident_name, datetime, xmin, ymin, xmax, ymax)"""

RECORDS = """SELECT o_orderkey AS ID, c_mktsegment AS segment, o_orderpriority AS priority,
  CASE o_orderkey % 4 WHEN 0 THEN 'Order' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Buffer' ELSE 'Outside' END AS ZoneType,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS DepartureDate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN o_orderdate + INTERVAL '2' DAY
    ELSE o_orderdate + INTERVAL '9' DAY END AS ReturnDate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '1' DAY
    WHEN o_orderkey % 3 = 1 THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate + INTERVAL '4' DAY END AS OrderStart,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate + INTERVAL '5' DAY END AS OrderEnd,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '1' DAY ELSE o_orderdate - INTERVAL '3' DAY END AS FireStart,
  (o_orderkey % 97 - 20) * 5e-1 AS DelayHours, (o_orderkey % 3500) * 1e-1 AS eu_distance_km, o_orderkey % 3 + 1 AS dest_order,
  CASE o_orderkey % 9 WHEN 0 THEN 'Single Family Home' WHEN 1 THEN 'Motel' WHEN 2 THEN 'Public Park' WHEN 3 THEN 'Parking Lot' WHEN 4 THEN 'City Park'
    WHEN 5 THEN 'WAREHOUSE' WHEN 6 THEN NULL WHEN 7 THEN 'zoo' ELSE 'Highway 5' END AS UseType
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

#: Vertices (perimeter, k, x, y) of perimeters: a jagged line of up to 100,000 events above a straight base.
PERIMETERS = """SELECT event_id DIV 100000 AS perimeter, event_id % 100000 AS k, -118.510013e0 + (event_id % 100000) * 4e-5 AS x,
  34.2e0 + (event_id * 7919 % 1000) * 1e-4 AS y FROM {events}"""

#: Nine in ten events within a ten-thousandth of a degree, the others anywhere in a degree.
CROWD = """SELECT event_id, CASE WHEN event_id % 10 < 9 THEN 5e-1 + (event_id % 97) * 1e-6 ELSE (event_id * 7919 % 10007) / 10007e0 END AS _x,
  CASE WHEN event_id % 10 < 9 THEN 5e-1 + (event_id % 89) * 1e-6 ELSE (event_id * 104729 % 10009) / 10009e0 END AS _y FROM {events}"""

#: A rectangle for each part, of many sizes, some very wide.
LOTS = """SELECT p_partkey AS lot, xmin, ymin, xmin + (p_partkey % 13 + 1) * 1e-3 + CASE WHEN p_partkey % 50 = 0 THEN 6e-1 ELSE 0e0 END AS xmax,
  ymin + (p_partkey % 7 + 1) * 1e-3 AS ymax FROM (SELECT p_partkey, (p_partkey * 7907 % 9973) / 9973e0 AS xmin, (p_partkey * 6007 % 9949) / 9949e0 AS ymin FROM {part}) AS p"""

#: A zone for each event: the users' zones over time, with status, fire and rectangle.
SNAPSHOTS = """SELECT CAST(user_id AS STRING) AS zoneId, CASE event_id % 3 WHEN 0 THEN 'Evacuation Order' WHEN 1 THEN 'Evacuation Warning' ELSE 'Normal' END
  AS most_extreme_status, concat('fire ', CAST(event_id AS STRING)) AS incident_name, substring(CAST(ts AS STRING), 1, 19) AS datetime,
  user_id * 1e-2 AS xmin, 34e0 + (event_id % 100) * 1e-2 AS ymin, user_id * 1e-2 + 5e-3 AS xmax, 34e0 + (event_id % 100) * 1e-2 + 5e-3 AS ymax FROM {events}"""

#: Squares of a grid, some in each customer's nation.
TRACTS = """SELECT DISTINCT county, -118.5e0 + i * 1e-2 AS xmin, 34e0 + j * 1e-2 AS ymin, -118.5e0 + (i + 1) * 1e-2 AS xmax, 34e0 + (j + 1) * 1e-2 AS ymax, i, j
  FROM (SELECT c_nationkey % 5 AS county, c_custkey % 40 AS i, c_custkey * 7 % 37 AS j FROM {customer}) AS c"""

#: Orders within the month of the events, at full minutes.
ORDER_TIMES = """SELECT o_custkey, o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + CAST(o_orderkey * 7919 % 43200 AS INT) * INTERVAL '1' MINUTE AS ordered
  FROM {orders}"""

#: A place and the corners of two rectangles for each event, none on a border of the other.
CHANGES = """SELECT event_id, (event_id % 101) / 101e0 AS x, (event_id * 7 % 103) / 103e0 AS y, (event_id % 10) / 20e0 + 7e-4 AS ax, (event_id % 9) / 18e0 + 7e-4 AS ay,
  (event_id % 7) / 14e0 + 1e-3 AS bx, (event_id % 8) / 16e0 + 1e-3 AS by FROM {events}"""

#: Roads as segments (x1, y1, x2, y2): two parallels and a meridian.
ROADS = [(-118.6, 34.1402, -118.0, 34.1402), (-118.6, 34.2601, -118.0, 34.2601), (-118.3003, 33.9, -118.3003, 34.6)]

#: Clusters of these sparse pings: a wide radius, and breaks after two days.
CLUSTERS = ClusterConfig(radius_m=2000.0, min_dwell_s=300.0, max_gap_s=172_800.0)
FIRES = {"East Fire": "2024-01-07 12:00:00", "West Fire": "2024-01-07 18:00:00"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PINGS, "events")


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HOMES, "events")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(ZONES)
    return rows.select(
        "zoneId", "most_extreme_status", "incident_name", "datetime",
        rectangle(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("geometry")
    )


def perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings of the vertices, with two corners below."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = view(spark, sf_dir, PERIMETERS, "events").groupBy("perimeter").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("v"))
    line = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    first, last = F.element_at("v", 1), F.element_at("v", -1)
    ring = F.concat(line, F.array(corner(last["x"], F.lit(33.9)), corner(first["x"], F.lit(33.9)), corner(first["x"], first["y"])))
    return rows.select("perimeter", F.array(F.array(ring)).alias("geometry"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RECORDS, "orders", "customer")
