"""Scenarios of clusters, chains, departures, behaviour, destinations, routes and local time on tiny tables."""

import datetime as dt
import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from wayfare.functions import clock, contracts, geo, text
from wayfare.operators import behavior, clustering, departure, destination, homes, residents, routes, trip_chain

HOME = (34.05, -118.25)


def ts(value):
    return dt.datetime.fromisoformat(value)


def pings(spark, rows, user="u1", kind="timestamp_ntz"):
    data = [(user, ts(t), float(y), float(x)) for t, y, x in rows]
    return spark.createDataFrame(data, f"ID string, datetime {kind}, latitude double, longitude double")


def home_table(spark, user="u1"):
    return spark.createDataFrame([(user, *HOME)], "ID string, home_lat_4326 double, home_lon_4326 double")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_haversine(spark):
    lit = F.lit
    assert value(spark, geo.haversine_m(lit(34.0), lit(-118.0), lit(34.0), lit(-118.0))) == 0.0
    assert 550e3 < value(spark, geo.haversine_m(lit(34.0522), lit(-118.2437), lit(37.7749), lit(-122.4194))) < 570e3


def test_utm_round_trip(spark):
    utm = geo.Utm()
    rows = spark.range(200).select((30 + F.col("id") * 0.1).alias("y"), (-120 + F.col("id") * 0.03).alias("x"))
    e, n = utm.forward(F.col("y"), F.col("x"))
    y, x = utm.inverse(F.col("e"), F.col("n"))
    rows = rows.withColumns({"e": e, "n": n}).withColumns({"y2": y, "x2": x})
    worst = rows.agg(F.max(F.greatest(F.abs(F.col("y") - F.col("y2")), F.abs(F.col("x") - F.col("x2"))))).first()[0]
    assert worst < 1e-8
    with pytest.raises(ValueError):
        geo.Utm(3857)


def test_polygon_with_hole_and_border(spark):
    ring = lambda a, b: F.array(
        *[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    )
    shape = F.array(F.array(ring(0, 10), ring(4, 6)))
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)), shape)
    assert value(spark, geo.inside(*at(1, 1))) and not value(spark, geo.inside(*at(5, 5))) and not value(spark, geo.inside(*at(11, 5)))
    assert value(spark, geo.intersects(*at(10, 5))) and not value(spark, geo.within(*at(10, 5)))
    assert value(spark, geo.distance(*at(13, 14))) == pytest.approx(5.0)
    assert value(spark, geo.distance(*at(5, 5))) == pytest.approx(1.0)


def test_cluster_dwell(spark):
    here = [("2025-01-01T09:00", *HOME), ("2025-01-01T09:03", *HOME), ("2025-01-01T09:06", *HOME)]
    found = clustering.incremental_cluster(pings(spark, here)).collect()
    assert [r.n for r in found] == [3]
    assert clustering.incremental_cluster(pings(spark, [here[0], ("2025-01-01T09:02", *HOME)])).count() == 0
    assert clustering.incremental_cluster(pings(spark, [])).count() == 0
    two = [("2025-01-01T08:00", *HOME), ("2025-01-01T08:10", *HOME), ("2025-01-01T10:00", 34.02, -118.5), ("2025-01-01T10:10", 34.02, -118.5)]
    assert clustering.incremental_cluster(pings(spark, two)).count() == 2


def test_clusters_skip_bad_coordinates(spark):
    data = [
        ("u", ts("2025-01-01T09:00"), *HOME), ("u", ts("2025-01-01T09:03"), None, -118.0),
        ("u", ts("2025-01-01T09:04"), float("nan"), -118.0), ("u", ts("2025-01-01T09:06"), *HOME),
        (None, ts("2025-01-01T09:06"), *HOME), ("u", None, *HOME)
    ]
    df = spark.createDataFrame(data, "ID string, datetime timestamp_ntz, latitude double, longitude double")
    assert [r.n_points for r in clustering.cluster_points(df).collect()] == [2]


def plain_clusters(rows, config):
    from wayfare.streaming.clusters import Engine

    engine, out = Engine(config), []
    for t, y, x in sorted(rows):
        out += list(engine.update(t, y, x))
    return out + list(engine.flush())


@pytest.mark.parametrize("gap", [None, 900.0])
def test_fold_equals_state_machine(spark, gap):
    r, config = random.Random(4), clustering.ClusterConfig(200.0, 300.0, gap)
    start, data, plain = ts("2025-01-01T00:00"), [], {}
    for user in range(12):
        y, x, t = HOME[0], HOME[1], 0
        for _ in range(80):
            t += r.randint(30, 1500)
            if r.random() < 0.2:
                y, x = y + r.uniform(-0.01, 0.01), x + r.uniform(-0.01, 0.01)
            row = (t * 1_000_000, y + r.uniform(-5e-4, 5e-4), x)
            plain.setdefault(str(user), []).append(row)
            data.append((str(user), start + dt.timedelta(seconds=t), row[1], row[2]))
    df = spark.createDataFrame(data, "ID string, datetime timestamp_ntz, latitude double, longitude double")
    expected = {u: [(e[0], e[1], e[6]) for e in plain_clusters(rows, config)] for u, rows in plain.items()}
    events = clustering.cluster_events(df, config=config).orderBy("user_id", "seq").collect()
    got = {}
    for e in events:
        got.setdefault(e.user_id, []).append((e.event_type, e.cluster_id, e.n_points))
    assert got == expected
    closed = {(u, e[1], e[2]) for u, rows in expected.items() for e in rows if e[0] == "cluster_closed"}
    assert {(r.user_id, r.cluster_id, r.n_points) for r in clustering.cluster_points(df, config=config).collect()} == closed


def test_chain_roles_and_return(spark):
    away = [
        ("2025-01-01T12:00", 34.1, -118.3), ("2025-01-01T12:20", 34.1, -118.3), ("2025-01-01T21:00", 34.2, -118.4), ("2025-01-01T23:00", 34.2, -118.4)
    ]
    roles = [
        r.stop_role for r in trip_chain.build_trip_chain(
            pings(spark, away), home_table(spark), rules=trip_chain.TripChainConfig(home_radius_m=300.0)
        ).orderBy("seq_idx").collect()
    ]
    assert roles == ["intermediate", "overnight"]
    trip = [
        ("2025-01-01T08:00", *HOME), ("2025-01-01T08:20", *HOME), ("2025-01-01T10:00", 34.2, -118.4),
        ("2025-01-01T11:00", 34.2, -118.4), ("2025-01-01T13:00", *HOME), ("2025-01-01T13:20", *HOME)
    ]
    roles = [r.stop_role for r in trip_chain.build_trip_chain(pings(spark, trip), home_table(spark)).orderBy("seq_idx").collect()]
    assert roles == ["home", "destination", "return"]
    assert trip_chain.build_trip_chain(pings(spark, trip)).where("stop_role in ('home', 'return')").count() == 0


def test_jitter_merges_to_one_stop(spark):
    rows = []
    for k in range(4):
        y = HOME[0] + 0.0008 * (k % 2)
        rows += [
            (f"2025-01-01T{9 + k // 2:02d}:{30 * (k % 2):02d}", y, HOME[1]), (f"2025-01-01T{9 + k // 2:02d}:{30 * (k % 2) + 10:02d}", y, HOME[1])
        ]
    rules = trip_chain.TripChainConfig(merge_distance_m=200.0, merge_gap_s=1800.0)
    found = trip_chain.build_trip_chain(pings(spark, rows), clustering=clustering.ClusterConfig(radius_m=50.0), rules=rules)
    assert found.count() == 1 and found.first().stop_id == 4


def test_compute_trip_chain_names(spark):
    data = [("u", 34.1, -118.3, 1736251200000), ("u", 34.1, -118.3, 1736252400000)]
    df = spark.createDataFrame(data, "GRID string, LAT double, LONG double, TIMESTAMP long")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert trip_chain.compute_trip_chain(df).count() == 1
    with pytest.raises(contracts.InputError):
        trip_chain.compute_trip_chain(df.drop("LAT"))


def test_origin(spark):
    fire = home_table(spark).withColumn("fire", F.lit("2025-01-01 09:00:00").cast("timestamp_ntz"))
    at_home = pings(spark, [("2025-01-01T10:00", *HOME), ("2025-01-01T10:05", *HOME)])
    assert departure.find_origin(at_home, fire, F.col("fire")).first().origin_type == "home"
    far = pings(spark, [("2025-01-01T08:50", 34.02, -118.5), ("2025-01-01T08:56", 34.02, -118.5), ("2025-01-01T09:10", 34.02, -118.5)])
    row = departure.find_origin(far, fire, F.col("fire")).first()
    assert row.origin_type == "activity" and row.origin_lat == pytest.approx(34.02)


def test_departure_from_distance(spark):
    far = [50.0, 50.0, 5000.0, 5000.0, 5000.0, 100.0, 100.0]
    data = [("u", 1735732800000 + k * 86_400_000, d) for k, d in enumerate(far)]
    df = spark.createDataFrame(data, "user_id string, timestamp_ms long, distance_to_home double")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        row = departure.infer_from_distance(df, "distance_to_home").first()
    assert (str(row.departure)[:10], str(row["return"])[:10]) == ("2025-01-03", "2025-01-05")


def test_delay_hours(spark):
    pairs = [("2025-01-02 12:00", "2025-01-01 12:00"), ("2025-01-01 10:00", "2025-01-01 12:00"), ("bad", "2025-01-01 12:00")]
    df = spark.createDataFrame(pairs, "d string, o string")
    assert [r.v for r in df.select(clock.delay_hours(F.col("d"), F.col("o")).alias("v")).collect()] == [24.0, -2.0, None]


RECORD = "ID string, ZoneType string, OrderStart timestamp_ntz, FireStart timestamp_ntz, DepartureDate timestamp_ntz, ReturnDate timestamp_ntz, OrderEnd timestamp_ntz"


def test_record_categories(spark):
    order, fire, end = ts("2025-01-02T12:00"), ts("2025-01-01T12:00"), ts("2025-01-09T12:00")
    late, early = ts("2025-01-02T14:00"), ts("2025-01-01T15:00")
    rows = [
        ("SELE", "Order", order, fire, early, None, None), ("FEUO", "Order", order, fire, late, None, None), ("FEUW", "Warning", order, fire, late, None, None), (
            "SEFN", "Buffer", order, fire, late, None, None
        ),
        ("NER", "Order", order, fire, None, None, None), ("UR", "Order", None, fire, late, None, None), ("PERE", "Order", order, fire, late, ts("2025-01-05T00:00"), end), (
            "UR", "Order", order, fire, ts("2025-01-01T10:00"), None, None
        ),
        ("NER", "Order", order, fire, early, ts("2025-01-01T20:00"), None),
    ]
    found = behavior.classify(spark.createDataFrame(rows, RECORD), fire_start="FireStart")
    assert all(r.ID == r.Category for r in found.collect())
    table = behavior.summary(found).collect()
    assert [r.Category for r in table] == ["SELE", "PERE", "FEUW", "FEUO", "SEFN", "NER", "UR"] and sum(r.Count for r in table) == len(rows)


def nightly(spark, rows):
    return spark.createDataFrame(rows, "ID string, stop_lat_4326 double, stop_lon_4326 double, stop_date string, duration int")


def test_destinations(spark):
    homes_ = spark.createDataFrame([("A", *HOME), ("B", *HOME)], "ID string, home_lat_4326 double, home_lon_4326 double")
    run = lambda rows, **k: [
        (r.ID, r.dest_order) for r in destination.infer_destinations(nightly(spark, rows), homes_, **k).orderBy("ID", "dest_order").collect()
    ]
    assert run([("A", 34.1, -118.3, "2025-01-08", 60)]) == [("A", 1)]
    assert run([("A", 34.0501, -118.2501, "2025-01-08", 60)], home_buffer_m=1000.0) == []
    assert run([("A", 34.1, -118.3, "2025-01-08", 60), ("A", 34.1001, -118.3001, "2025-01-09", 60)]) == [("A", 1)]
    assert run([("A", 34.1, -118.3, "2025-01-08", 60), ("A", 34.4, -118.3, "2025-01-09", 60)]) == [("A", 1), ("A", 2)]
    assert run([("A", 34.1, -118.3, "2025-01-08", 60), ("B", 34.1, -118.3, "2025-01-08", 60)]) == [("A", 1), ("B", 1)]
    assert run([]) == []
    # The middle stop is near the first, the last is near the middle but far from the first, which is the anchor.
    assert run(
        [("A", 34.1, -118.3, "2025-01-08", 1), ("A", 34.103, -118.3, "2025-01-09", 1), ("A", 34.106, -118.3, "2025-01-10", 1)]
    ) == [("A", 1), ("A", 2)]


def test_land_use(spark):
    dest = spark.createDataFrame(
        [("a", 1, 0.5, 0.5), ("b", 1, 0.5, 1.0003), ("c", 1, 5.0, 5.0), ("d", 1, 3.0, 3.0001)],
        "ID string, dest_order long, dest_lat double, dest_lon double"
    )
    corner = geo.rectangle(*(F.lit(float(v)) for v in (0, 0, 1, 1)))
    parcels = spark.range(1).select(corner.alias("geometry"), F.lit("Public Park").alias("UseType"))
    roads = spark.range(1).select(F.array(F.array(*[F.struct(F.lit(3.0).alias("x"), F.lit(float(y)).alias("y")) for y in (2, 4)])).alias("lines"))
    found = {r.ID: r.dest_type for r in destination.classify_destinations(dest, parcels, roads).collect()}
    assert found == {"a": "public", "b": "public", "c": "unknown", "d": "road"}
    assert destination.classify_destinations(dest, None).where("dest_type is not null").count() == 0


def test_keywords_and_title(spark):
    words = ["Parking lot", "City PARK", "Vacant Residential", "zoo", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.v for r in df.select(text.standardize_type(F.col("w")).alias("v")).collect()] == [
        "commercial", "open space", "residential", "other", None
    ]
    assert value(spark, text.title_case(F.lit("o'neil creek-fire 2nd"))) == "o'neil creek-fire 2nd".title()


def test_routes(spark):
    chain = trip_chain.build_trip_chain(
        pings(
            spark, [("2025-01-01T08:00", *HOME), ("2025-01-01T08:20", *HOME), ("2025-01-01T10:00", 34.2, -118.4), ("2025-01-01T11:00", 34.2, -118.4)]
        )
    )
    legs = routes.build_trip_legs(chain)
    assert legs.count() == 1 and legs.first().displacement_m > 0
    assert routes.infer_route_candidates(legs).first().route_status == "unresolved_strategy"
    stub = lambda df, graph: df.select("user_id", "from_seq", "to_seq", F.lit("ok_custom").alias("route_status"), F.lit(1.0).alias("route_length_m"))
    row = routes.infer_route_candidates(legs, strategy="custom_stub", strategy_fn=stub).first()
    assert (row.strategy, row.route_status) == ("custom_stub", "ok_custom")
    with pytest.raises(TypeError):
        routes.infer_route_candidates(legs, strategy_fn=lambda df, graph: 1)
    with pytest.raises(contracts.InputError):
        routes.infer_route_candidates(legs, strategy_fn=lambda df, graph: df.select("user_id"))


def test_local_time(spark):
    instant = F.lit("2025-01-07 18:30:00").cast("timestamp")
    assert str(value(spark, clock.local_clock(instant, "timestamp", "America/Los_Angeles"))) == "2025-01-07 10:30:00"
    naive = F.lit("2025-01-07 10:30:00").cast("timestamp_ntz")
    assert str(value(spark, clock.local_clock(naive, "timestamp_ntz", "America/Los_Angeles"))) == "2025-01-07 10:30:00"
    rows = pings(spark, [("2025-01-07T21:00", 34.2, -118.4), ("2025-01-07T23:00", 34.2, -118.4)], kind="timestamp")
    assert not trip_chain.build_trip_chain(rows, local_tz="America/Los_Angeles").first().is_overnight
    with pytest.warns(UserWarning):
        assert trip_chain.build_trip_chain(rows).first().is_overnight


def test_home_from_nights(spark):
    rows = []
    for day in range(6):
        # 22:00 and 23:30 in Los Angeles are 06:00 and 07:30 UTC of the next day; midday there is 20:00 UTC.
        rows += [
            (f"2025-01-{day + 2:02d}T06:00", *HOME), (f"2025-01-{day + 2:02d}T07:30", *HOME),
            (f"2025-01-{day + 2:02d}T20:00", 34.2, -118.4), (f"2025-01-{day + 2:02d}T21:30", 34.2, -118.4)
        ]
    df = pings(spark, rows, kind="timestamp")
    found = lambda tz: homes.infer_homes(df, min_nights=4, local_tz=tz, user="ID").first()
    assert found("America/Los_Angeles").home_lat_4326 == pytest.approx(HOME[0], abs=1e-3)
    with pytest.warns(UserWarning):
        assert found(None).home_lat_4326 == pytest.approx(34.2, abs=1e-3)


def test_contracts(spark):
    bad = spark.createDataFrame([(1.0,)], "LAT double")
    with pytest.raises(contracts.InputError):
        contracts.validate(bad, contracts.PINGS)
    good = spark.createDataFrame([("a", "t", 1.0, 2.0)], "ID string, datetime string, LAT double, LONG double")
    assert contracts.canonicalize(good, contracts.PINGS).columns == ["ID", "datetime", "latitude", "longitude"]
    assert contracts.optional_missing(good, ["ID", "x", "y"]) == ["x", "y"]


def test_resident_local_delay(spark):
    rows = [("r", ts("2025-01-07T19:30"), True, 5.0), ("r", ts("2025-01-08T20:00"), True, 5.0), ("r", ts("2025-01-09T20:00"), True, 5.0)]
    stops = spark.createDataFrame(rows, "ID string, stop_date timestamp, is_outside_zone boolean, eu_distance double")
    stops = stops.withColumns(
        {"ZoneType": F.lit("Order"), "OrderStart": F.lit("2025-01-07 10:30:00"), "FireEvent": F.lit("Palisades"), "home_lon": F.lit(0.0)}
    )
    row = residents.infer_metrics(stops, {"Palisades": "2025-01-07 10:00:00"}, local_tz="America/Los_Angeles").first()
    assert str(row.DepartureDate) == "2025-01-07 11:30:00" and row.DelayHours == pytest.approx(1.0) and row.is_evacuee
    assert not math.isnan(row.DelayHours)
    empty = residents.infer_metrics(stops.where("false"), {"Palisades": "2025-01-07 10:00:00"}, local_tz="America/Los_Angeles")
    assert empty.count() == 0


def test_streamed_rows_need_no_data_frame_and_no_list_of_timers():
    from pyspark.sql import Row

    from wayfare.operators.clustering import ClusterConfig
    from wayfare.streaming.clusters import ClusterProcessor

    class Store:
        held, timers = None, set()

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    store, processor = Store(), ClusterProcessor(ClusterConfig(radius_m=100.0, min_dwell_s=1.0, max_gap_s=60.0))
    processor.init(store)
    row = lambda s, lat: Row(user_id="u", us=s * 1_000_000, latitude=lat, longitude=5.0)
    kinds = lambda rows: [e.event_type for e in processor.handleInputRows(("u",), iter(rows), None)]
    assert kinds([row(20, 1.0), row(10, 1.0), row(15, None), row(16, float("nan"))]) == ["cluster_started", "cluster_updated"] and store.timers == {80_001}
    assert kinds([row(5, 1.0)]) == [] and store.timers == {80_001}  # late
    assert kinds([row(30, 2.0)]) == ["cluster_closed", "cluster_started"] and store.timers == {90_001}
    assert [e.event_type for e in processor.handleExpiredTimer(("u",), None, None)] == [] and store.held[1] == 0
