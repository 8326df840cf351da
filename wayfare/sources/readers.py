"""Readers and writers: CSV, GeoJSON and Parquet by Spark's own sources, optional pickled shards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.contracts import InputError
from ..functions.text import number
from .geojson import read_collections, read_features

TIMES = ["DepartureDate", "ReturnDate", "OrderStart", "OrderEnd", "FireStart"]


def read_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Evacuation records from CSV; time columns that are there become timestamps, bad values null."""
    df = spark.read.csv(path, header=True)
    return df.withColumns({c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in TIMES if c in df.columns})


def read_homes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Homes from CSV with home_lat_4326 and home_lon_4326 (or home_lat and home_lon, copied)."""
    df = spark.read.csv(path, header=True)
    for axis in ("lat", "lon"):
        wanted, other = f"home_{axis}_4326", f"home_{axis}"
        if wanted not in df.columns:
            if other not in df.columns:
                raise InputError(f"homes: missing column {wanted}")
            df = df.withColumn(wanted, F.col(other))
        df = df.withColumn(wanted, number(F.col(wanted)))
    return df


def reproject_homes(df: DataFrame, x: str = "home_lat_3857", y: str = "home_lon_3857") -> DataFrame:
    """Adds degrees from Web-Mercator metres; by default for tables whose two metre columns have each other's names."""
    return df.withColumns({"home_lon_4326": geo.mercator_lon(F.col(x).cast("double")), "home_lat_4326": geo.mercator_lat(F.col(y).cast("double"))})


def _rings(value: Column) -> Column:
    return F.transform(
        value, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    )


def geojson_geometry(feature: Column) -> Column:
    """The geometry of a GeoJSON feature (JSON text): Polygon and MultiPolygon; anything else gives null."""
    kind = F.get_json_object(feature, "$.geometry.type")
    coordinates = F.get_json_object(feature, "$.geometry.coordinates")
    one, many = F.from_json(coordinates, "array<array<array<double>>>"), F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", _rings(F.array(one))).when(kind == "MultiPolygon", _rings(many))


def geojson_lines(feature: Column) -> Column:
    """The lines of a GeoJSON feature: LineString and MultiLineString."""
    kind = F.get_json_object(feature, "$.geometry.type")
    coordinates = F.get_json_object(feature, "$.geometry.coordinates")
    points = lambda lines: F.transform(lines, lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return F.when(kind == "LineString", points(F.array(F.from_json(coordinates, "array<array<double>>")))).when(
        kind == "MultiLineString", points(F.from_json(coordinates, "array<array<array<double>>>"))
    )


def read_geojson(
    spark: SparkSession, path: str | list[str], properties: list[str], lines: bool = False, split: int | None = None,
    box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Features of GeoJSON files with some properties as strings; coordinates in EPSG:3857 (named by the file's crs) are
    turned into degrees. A file that cannot be parsed as a whole drops out. With ``split`` (bytes) one large file,
    or a folder's, is read in pieces of that size, see ``geojson``; ``box`` then leaves out features that do not touch it
    (in the file's coordinates)."""
    found = read_features(spark, path, split, box) if split else read_collections(spark, path)
    rows = found.select(F.col("crs").alias("_crs"), F.col("feature").alias("f"))
    shape = geojson_lines(F.col("f")) if lines else geojson_geometry(F.col("f"))
    back = lambda p: F.struct(geo.mercator_lon(p["x"]).alias("x"), geo.mercator_lat(p["y"]).alias("y"))
    degrees = F.transform(shape, lambda r: F.transform(r, back)) if lines else F.transform(
        shape, lambda g: F.transform(g, lambda r: F.transform(r, back))
    )
    shape = F.when(F.col("_crs").endswith("3857"), degrees).otherwise(shape)
    return rows.select(
        *[F.get_json_object("f", f"$.properties.{p}").alias(p) for p in properties], shape.alias("lines" if lines else "geometry")
    ).where(F.col("lines" if lines else "geometry").isNotNull())


def read_fire_timeline(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Evacuation zones of one or more GeoJSON snapshots; for each zone and status the latest datetime."""
    rows = read_geojson(spark, path, ["zoneId", "most_extreme_status", "incident_name", "datetime", "OrderEnd"])
    return latest_zones(rows)


def latest_zones(rows: DataFrame) -> DataFrame:
    latest = Window.partitionBy("zoneId", "most_extreme_status").orderBy(F.col("datetime").desc_nulls_last(), F.col("incident_name"))
    return rows.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")


def read_roads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_geojson(spark, path, [], lines=True)


def bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows in a box, borders included: plain comparisons that reach Parquet statistics."""
    return df.where(F.col(lon).between(xmin, xmax) & F.col(lat).between(ymin, ymax))


def normalize_pings(df: DataFrame, id_col: str = "GRID") -> DataFrame:
    """Pings under the usual names: ID, latitude, longitude, and datetime from datetime, TIMESTAMP (epoch milliseconds, or
    ISO text), timestamp_ms or Date, whichever comes first."""
    names = {id_col: "ID", "GEOHASHLAT": "LAT", "GEOHASHLONG": "LONG", "GEOHASHLON": "LONG"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})
    if "datetime" not in df.columns:
        found = next((c for c in ("TIMESTAMP", "timestamp_ms", "TIMESTAMP_EPOCH_MILLISECOND", "Date") if c in df.columns), None)
        if found is None:
            raise InputError("pings: no time column")
        text = F.col(found).cast("string")
        ms = F.timestamp_millis(text.try_cast("long"))
        df = df.withColumn("datetime", F.try_to_timestamp(text) if found == "Date" else F.coalesce(ms, F.try_to_timestamp(text)))
    for wanted, other in (("latitude", "LAT"), ("longitude", "LONG")):
        if wanted not in df.columns and other in df.columns:
            df = df.withColumn(wanted, number(F.col(other)))
    return df


def read_gps_csv(spark: SparkSession, path: str | list[str], id_col: str = "GRID") -> DataFrame:
    """Pings of one or more CSV files; no schema inference, so the files are read once."""
    return normalize_pings(spark.read.csv(path, header=True), id_col)


def read_shards(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, allow_pickle: bool = False) -> DataFrame:
    """Pings of pickled shards ``shard_*.pkl``, each (residents, list of dicts). Reading a pickle can run code, so it must be
    allowed, and only plain containers, numbers and strings are let through. A bad shard drops out."""
    if not allow_pickle:
        raise PermissionError("pickled shards are read only with allow_pickle=True; prefer Parquet or CSV")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import pickle

        class Plain(pickle.Unpickler):
            def find_class(self, module: str, name: str):
                if module == "builtins" and name in ("set", "frozenset", "complex", "bytearray"):
                    return getattr(__import__("builtins"), name)
                raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

        for batch in batches:
            for content in batch["content"]:
                try:
                    rows = pd.DataFrame(Plain(io.BytesIO(content)).load()[1])
                except Exception:  # noqa: BLE001 - a bad shard is skipped by contract
                    continue
                rows = rows.rename(columns={"GRID": "user_id", "LAT": "latitude", "LONG": "longitude", "TIMESTAMP": "timestamp_ms"})
                out = rows.reindex(columns=["user_id", "latitude", "longitude", "timestamp_ms"])
                yield out.astype({"user_id": str, "latitude": float, "longitude": float}).assign(timestamp_ms=out["timestamp_ms"].astype("int64"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard_*.pkl").load(path).select("content")
    rows = files.mapInPandas(decode, "user_id string, latitude double, longitude double, timestamp_ms long")
    return (bbox(rows, *box) if box else rows).withColumn("datetime", F.timestamp_millis("timestamp_ms"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Writes a table as Parquet or CSV."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown kind: {kind}")
    writer = df.write.mode(mode).partitionBy(*(partition_by or []))
    writer.parquet(path) if kind == "parquet" else writer.csv(path, header=True)
