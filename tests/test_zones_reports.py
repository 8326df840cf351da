"""Zones, reports, sources and the stream of cluster events."""

import datetime as dt
import json
import pickle
import warnings

import pytest
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.functions.contracts import InputError
from wayfare.operators import clustering, reports, residents
from wayfare.operators.zones import assign_regions, classify_zones
from wayfare.sources import readers
from wayfare.streaming.clusters import close_open_clusters, stream_cluster_events


def square(x, y, size=0.1):
    return (float(x), float(y), float(x + size), float(y + size))


def zone_table(spark, rows):
    df = spark.createDataFrame(
        rows, "zoneId string, most_extreme_status string, incident_name string, datetime string, a double, b double, c double, d double"
    )
    return df.select("zoneId", "most_extreme_status", "incident_name", "datetime", geo.rectangle(*(F.col(c) for c in "abcd")).alias("geometry"))


def home_table(spark, rows):
    return spark.createDataFrame(rows, "ID string, home_lon_4326 double, home_lat_4326 double")


def test_zone_labels(spark):
    zones = zone_table(
        spark,
        [
            ("z1", "Evacuation Order", "eaton", "2025-01-01T12:00", *square(-118, 34)),
            ("z2", "Evacuation Warning", "eaton", "2025-01-01T13:00", *square(-117.9, 34)),
            ("z3", "Normal", "other", "2025-01-01T13:00", *square(-110, 40))
        ]
    )
    homes = home_table(
        spark,
        [
            ("h1", -117.95, 34.05), ("h2", -117.85, 34.05), ("h3", -118.1, 34.05), ("h4", -119.5, 34.05), ("h5", -109.95, 40.05),
            ("edge", -118.0, 34.05), ("none", None, None), ("h1", -119.5, 34.05)
        ]
    )
    found = {r.ID: r for r in classify_zones(homes, zones, buffer_distance=20_000.0).collect()}
    assert {k: r.ZoneType for k, r in found.items()} == {
        "h1": "Outside", "h2": "Warning", "h3": "Buffer", "h4": "Outside", "h5": "Unknown", "edge": "Order", "none": "Outside"
    }
    assert found["h3"].FireEvent == "Eaton" and found["h3"].OrderStart is None and found["edge"].OrderStart == "2025-01-01T12:00"


def test_buffer_takes_the_nearest_fire(spark):
    zones = zone_table(
        spark, [("p", "Evacuation Order", "palisades", "1", *square(-118.6, 34)), ("e", "Evacuation Order", "eaton", "1", *square(-118.0, 34))]
    )
    homes = home_table(spark, [("hA", -118.55, 34.05), ("hB", -118.05, 34.05), ("far", -117.0, 34.05)])
    found = {r.ID: (r.ZoneType, r.FireEvent) for r in classify_zones(homes, zones, buffer_distance=10_000.0).collect()}
    assert found == {"hA": ("Order", "Palisades"), "hB": ("Buffer", "Eaton"), "far": ("Outside", None)}


def test_regions(spark):
    regions = spark.range(1).select(geo.rectangle(*(F.lit(float(v)) for v in (0, 0, 1, 1))).alias("geometry"), F.lit("north").alias("region"))
    points = home_table(spark, [("a", 0.5, 0.5), ("b", 2.0, 2.0)])
    assert {r.ID: r.region for r in assign_regions(points, regions, "region").collect()} == {"a": "north", "b": "Other"}


def test_stops_and_imputation(spark):
    zones = zone_table(spark, [("z1", "Evacuation Order", "eaton", "1", *square(-118, 34))])
    zoned = classify_zones(home_table(spark, [("a", -117.95, 34.05), ("b", -100.0, 34.05)]), zones)
    t = dt.datetime(2025, 1, 1)
    rows = [
        ("a", t, "34.05", "-117.95"), ("a", t + dt.timedelta(hours=1), "34.05", "-117.5"),
        ("a", t + dt.timedelta(hours=2), "x", "-117.5"), ("b", t, "34.05", "-100")
    ]
    pings = spark.createDataFrame(rows, "ID string, datetime timestamp_ntz, LAT string, LONG string")
    found = residents.compute_stops(pings, zoned, zones).orderBy("stop_date").collect()
    assert [r.ID for r in found] == ["a"] * 3 and [r.is_outside_zone for r in found] == [False, True, True]
    assert found[0].eu_distance == pytest.approx(0, abs=1e-9) and found[2].eu_distance == found[1].eu_distance


def test_imputation_limits(spark):
    rows = [("half", 1, None), ("half", 2, 5.0), ("most", 1, None), ("most", 2, None), ("most", 3, 1.0)]
    df = spark.createDataFrame(rows, "ID string, t int, d double")
    assert [(r.ID, r.d) for r in residents.impute_distance(df, "ID", ["t"], "d").orderBy("t").collect()] == [("half", 0.0), ("half", 5.0)]


def test_compliance_and_curve(spark):
    rows = [("Order", "FEUO"), ("Order", "NER"), ("Order", "SELE"), ("Warning", "FEUW"), ("Warning", "NER"), (None, "NER")]
    found = {
        r.ZoneType: (r.Total_Residents, r.Evacuated, r.Compliance_Rate) for r in reports.compliance_rate(
            spark.createDataFrame(rows, "ZoneType string, Category string")
        ).collect()
    }
    assert found == {"Order": (3.0, 2.0, pytest.approx(2 / 3)), "Warning": (2.0, 1.0, 0.5)}
    t = lambda *a: dt.datetime(2025, 1, *a)
    deps = spark.createDataFrame(
        [("Order", t(1, 10)), ("Order", t(1, 14)), ("Order", t(2, 10)), ("Order", None), ("Warning", t(1, 1))],
        "ZoneType string, DepartureDate timestamp_ntz"
    )
    curve = {
        str(r.Datetime): (r.Cumulative_Count, r.Cumulative_Pct) for r in reports.departure_curve(
            deps, "2025-01-01 08:00", "2025-01-02 12:00", "2h"
        ).collect()
    }
    assert curve["2025-01-01 08:00:00"] == (0, 0.0) and curve["2025-01-01 12:00:00"] == (1, 25.0) and curve["2025-01-02 12:00:00"] == (3, 75.0)
    assert curve["2025-01-01 10:00:00"] == (0, 0.0)  # strictly before
    empty = reports.dedi(spark.createDataFrame(rows, "ZoneType string, Category string").where("false"))
    assert empty.count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.999,), (10.0,), (300.0,), (300.1,), (-1.0,)], "eu_distance_km double")
    assert {r.bin: r.n for r in reports.distance_histogram(df).collect()} == {0: 2, 1: 1, 29: 1}


def test_ks(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (3, 4, 5, 6)] + [("c", 1.0)]
    found = reports.ks_test(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    assert len(found) == 1 and found[0].statistic == 0.5
    # All 70 ways to interleave 4 and 4, counted.
    from itertools import combinations

    def gap(places):
        a = b = worst = 0
        for k in range(8):
            a, b = (a + 1, b) if k in places else (a, b + 1)
            worst = max(worst, abs(a - b))
        return worst / 4

    exact = sum(gap(p) >= 0.5 for p in combinations(range(8), 4)) / 70
    assert found[0].p_value == pytest.approx(exact, abs=1e-6)
    assert reports.ks_p_value(0.0, 5, 5) == 1.0 and reports.ks_p_value(0.2, 500, 500) < 1e-6


@pytest.mark.parametrize("bins", [2, 16, 128])
def test_ks_of_many_groups(spark, bins):
    """Every pair of 40 groups against running shares over all values; ties, a shared point mass, groups of one value."""
    import random

    r = random.Random(bins)
    groups = {f"g{k:02}": [round(r.gauss(k % 5, 1 + k % 3), 1 + k % 3) for _ in range(r.randint(2, 120))] + [1.0] * (k % 4) for k in range(40)}
    groups |= {"same": [3.0, 3.0, 3.0], "far": [1e9, 1e9 + 1], "low": [-1e300, -5e-324, 0.0], "one": [2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("g00", None), (None, 1.0)]
    r.shuffle(rows)
    found = {(x.group_a, x.group_b): (x.n_a, x.n_b, x.d) for x in reports.ks_statistics(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", bins).collect()}
    known = sorted(g for g, vs in groups.items() if len(vs) > 1)
    assert len(found) == len(known) * (len(known) - 1) // 2
    for (a, b), (n_a, n_b, d) in found.items():
        x, y = groups[a], groups[b]
        expected = max(abs(sum(u <= v for u in x) / len(x) - sum(u <= v for u in y) / len(y)) for v in {*x, *y})
        assert (n_a, n_b) == (len(x), len(y)) and d == pytest.approx(expected, abs=1e-12), (a, b)
    assert reports.ks_statistics(spark.createDataFrame([], "g string, v double"), "g", "v").collect() == []


def test_geojson(spark, tmp_path):
    feature = lambda t, geometry, **p: {
        "type": "Feature", "properties": {"zoneId": "z", "most_extreme_status": "Evacuation Order", "datetime": t, **p}, "geometry": geometry
    }
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    (tmp_path / "a.geojson").write_text(
        json.dumps({"type": "FeatureCollection", "features": [feature("2025-01-01", {"type": "Polygon", "coordinates": [ring]})]})
    )
    (tmp_path / "b.geojson").write_text(
        json.dumps(
            {
                "type": "FeatureCollection",
                "features": [
                    feature("2025-01-02", {"type": "MultiPolygon", "coordinates": [[ring]]}),
                    feature("2025-01-03", {"type": "Point", "coordinates": [0, 0]})
                ]
            }
        )
    )
    (tmp_path / "c.geojson").write_text("not json {")
    rows = readers.read_fire_timeline(spark, str(tmp_path)).collect()
    assert [r.datetime for r in rows] == ["2025-01-02"] and len(rows[0].geometry[0][0]) == 5
    (tmp_path / "roads").mkdir()
    (tmp_path / "roads" / "r.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}]}))
    assert len(readers.read_roads(spark, str(tmp_path / "roads")).first().lines[0]) == 2


def test_csv_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ID,DepartureDate\n1,2025-01-01 10:00:00\n2,bad\n")
    assert [r.DepartureDate is None for r in readers.read_metrics(spark, str(tmp_path / "m.csv")).orderBy("ID").collect()] == [False, True]
    (tmp_path / "h.csv").write_text("ID,home_lat,home_lon\n1,34,-118\n")
    assert readers.read_homes(spark, str(tmp_path / "h.csv")).first().home_lat_4326 == 34.0
    (tmp_path / "bad.csv").write_text("ID,x\n1,2\n")
    with pytest.raises(InputError):
        readers.read_homes(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "g.csv").write_text("GRID,LAT,LONG,TIMESTAMP\na,34,-118,1736274600000\n")
    row = readers.read_gps_csv(spark, str(tmp_path / "g.csv")).first()
    assert row.ID == "a" and str(row.datetime) == "2025-01-07 18:30:00" and row.latitude == 34.0
    df = spark.createDataFrame([("a", 1.0, 2.0)], "ID string, longitude double, latitude double")
    assert readers.bbox(df, 1.0, 2.0, 1.0, 2.0).count() == 1
    readers.write_table(df, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_pickled_shards(spark, tmp_path):
    rows = [
        {"GRID": "a", "LAT": 34.0, "LONG": -118.0, "TIMESTAMP": 1736274600000}, {"GRID": "b", "LAT": 10.0, "LONG": 10.0, "TIMESTAMP": 1736274600000}
    ]
    (tmp_path / "shard_1.pkl").write_bytes(pickle.dumps(({"a"}, rows)))
    (tmp_path / "shard_2.pkl").write_bytes(pickle.dumps(print))  # a function: not let through
    with pytest.raises(PermissionError):
        readers.read_shards(spark, str(tmp_path))
    found = readers.read_shards(spark, str(tmp_path), (-119.0, 33.0, -117.0, 35.0), allow_pickle=True).collect()
    assert [r.user_id for r in found] == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = dt.datetime(2025, 1, 1, 12)
    rows = [
        ("u", t, 34.1, -118.3), ("u", t + dt.timedelta(minutes=20), 34.1, -118.3),
        ("u", t + dt.timedelta(minutes=60), 34.2, -118.4), ("u", t + dt.timedelta(minutes=80), 34.2, -118.4),
        ("u", t + dt.timedelta(minutes=120), 34.3, -118.4)
    ]
    schema = "user_id string, datetime timestamp, latitude double, longitude double"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_cluster_events(source).writeStream.format("memory").queryName("events_out").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.event_type, r.cluster_id, r.n_points) for r in spark.table("events_out").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        batch = clustering.cluster_events(spark.createDataFrame(rows, schema), user="user_id").collect()
    assert sorted(got, key=str) == sorted([(r.event_type, r.cluster_id, r.n_points) for r in batch], key=str)


def test_open_clusters_are_flushed(spark, tmp_path):
    """Stream and flush together are the batch clusters of every user, over two micro-batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = dt.datetime(2025, 1, 1, 12)
    at = lambda u, minutes, lat: (u, t + dt.timedelta(minutes=minutes), lat, -118.3)
    parts = [
        [at("u", 0, 34.1), at("u", 20, 34.1), at("short", 0, 34.1), at("v", 0, 34.0), at("v", 9, 34.0)],
        [at("u", 60, 34.2), at("u", 90, 34.2), at("short", 1, 34.1), at("w", 95, 34.5)]
    ]
    schema = "user_id string, datetime timestamp, latitude double, longitude double"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = clustering.ClusterConfig()
    events = stream_cluster_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), config)
    query = events.writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    columns = ["user_id", "cluster_id", "n_points", "dwell_s", "centroid_lat", "start_time", "event_time"]
    streamed = [tuple(r) for r in spark.table("flushed").where("event_type = 'cluster_closed'").select(columns).collect()]
    flushed = [tuple(r) for r in close_open_clusters(spark, str(tmp_path / "cp"), config).select(columns).collect()]
    batch = clustering.cluster_points(spark.createDataFrame(parts[0] + parts[1], schema), user="user_id")
    batch = [tuple(r) for r in batch.select(*columns[:5], F.col("start_time").cast("timestamp"), F.col("end_time").cast("timestamp")).collect()]
    assert {r[0] for r in flushed} == {"u", "v"} and sorted(streamed + flushed) == sorted(batch)


def test_ecdf_is_positional(spark):
    values = [3.0, 1.0, 1.0, 250.0, 0.05, 0.04, 7.7]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "ID long, dest_order int, eu_distance_km double")
    found = sorted((r.distance, r.ecdf) for r in reports.distance_ecdf(df).collect())
    assert found == [(v, pytest.approx((k + 1) / 7)) for k, v in enumerate(sorted(values))]


def test_exact_ks_p_values():
    """Against a count of all interleavings of two small samples."""
    from itertools import combinations

    from wayfare.operators.reports import ks_p_value

    for n, m in ((3, 4), (5, 5), (2, 7), (1, 6)):
        found = []
        for places in combinations(range(n + m), n):
            a = b = 0
            worst = 0.0
            for k in range(n + m):
                a, b = a + (k in places), b + (k not in places)
                worst = max(worst, abs(a / n - b / m))
            found.append(round(worst * n * m))
        for limit in set(found):
            share = sum(x >= limit for x in found) / len(found)
            assert abs(ks_p_value(limit / (n * m), n, m) - share) < 1e-12
    assert abs(ks_p_value(0.03, 5000, 5000) - ks_p_value(0.03, 5000, 5000, "asymptotic")) < 1e-3


def test_shared_folder_is_asked_for_off_local_mode():
    from types import SimpleNamespace

    import pytest

    from wayfare.storage import shared_folder

    nothing = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=nothing, sparkContext=context))


def test_folders_are_removed(spark):
    import os

    from wayfare import storage

    path = storage.new_folder(spark, "test")
    storage.write_file(spark, f"{path}/a.txt", b"x")
    assert os.path.exists(path)
    storage.remove(spark, path)
    assert not os.path.exists(path)
