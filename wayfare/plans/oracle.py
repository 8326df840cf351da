"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import math

from ..functions.geo import Utm
from ..functions.text import LAND_USE
from . import fixtures as fx

P = fx.PINGS.format(events="events")
HOMES = fx.HOMES.format(events="events")
RECORDS = fx.RECORDS.format(orders="orders", customer="customer")


def _h(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({s}), sqrt(1e0 - {s})))"


def _x(lon: str) -> str:
    return f"(radians({lon}) * 6378137e0)"


def _y(lat: str) -> str:
    return f"(ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137e0)"


def _t(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def _us(c: str) -> str:
    return f"make_timestamp({c})"


def _type(value: str) -> str:
    rules = " ".join(f"WHEN contains(lower({value}), '{w}') THEN '{k}'" for k, words in LAND_USE for w in words.split(", "))
    return f"CASE WHEN {value} IS NULL THEN NULL {rules} ELSE 'other' END"


def _category() -> str:
    start = "CASE WHEN OrderStart IS NULL AND ZoneType IN ('Buffer', 'Outside') THEN FireStart ELSE OrderStart END"
    return f"""SELECT *, CASE WHEN s IS NULL THEN 'UR' WHEN DepartureDate IS NULL THEN 'NER'
      WHEN DepartureDate < s THEN CASE WHEN ReturnDate < s THEN 'NER' WHEN DepartureDate < FireStart THEN 'UR' ELSE 'SELE' END
      WHEN ZoneType = 'Buffer' THEN 'SEFN' WHEN ReturnDate <= OrderEnd THEN 'PERE' WHEN ZoneType = 'Warning' THEN 'FEUW'
        WHEN ZoneType = 'Order' THEN 'FEUO' ELSE 'UR' END AS Category
      FROM (SELECT *, {start} AS s FROM ({RECORDS}))"""


C = _category()
EVACUATED = "('SELE', 'PERE', 'FEUO', 'FEUW', 'SEFN')"


def _clusters(radius: float, dwell: float, gap: float | None, source: str = P) -> str:
    """CTEs pv, p, r and c: pings in order, the running cluster, clusters that count."""
    far = _h("r.sy / r.n", "r.sx / r.n", "p.y", "p.x") + f" > {radius}e0" + (f" OR (p.t - r.t) / 1e6 > {gap}" if gap else "")
    return f"""pv AS ({source}), p AS (SELECT ID, epoch_us(datetime) AS t, latitude AS y, longitude AS x, row_number() OVER (PARTITION BY ID ORDER BY datetime, CAST(event_id AS VARCHAR)) AS rn FROM pv),
    r AS (SELECT ID, rn, t, 1 AS cid, 1 AS n, y AS sy, x AS sx, y, x FROM p WHERE rn = 1
      UNION ALL SELECT p.ID, p.rn, p.t, CASE WHEN {far} THEN r.cid + 1 ELSE r.cid END, CASE WHEN {far} THEN 1 ELSE r.n + 1 END, CASE
        WHEN {far} THEN p.y ELSE r.sy + p.y END, CASE WHEN {far} THEN p.x ELSE r.sx + p.x END, p.y, p.x
      FROM r JOIN p ON p.ID = r.ID AND p.rn = r.rn + 1),
    c AS (SELECT ID, cid, avg(y) AS cy, avg(x) AS cx, min(t) AS s, max(t) AS e, count(*) AS n FROM r GROUP BY ID, cid HAVING (max(t) - min(t)) / 1e6 >= {dwell})"""


CLUSTERS = _clusters(fx.CLUSTERS.radius_m, fx.CLUSTERS.min_dwell_s, fx.CLUSTERS.max_gap_s)
_JOIN = "((k.s - m.e) / 1e6 <= 400000 AND " + _h("m.cy", "m.cx", "k.cy", "k.cx") + " <= 2500)"
CHAIN = f"""WITH RECURSIVE {CLUSTERS}, k AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY cid) AS k FROM c),
m AS (SELECT ID, k, cid, cy, cx, s, e, n, 1 AS g FROM k WHERE k = 1
  UNION ALL SELECT k.ID, k.k, CASE WHEN {_JOIN} THEN m.cid + 1 ELSE k.cid END, CASE WHEN {_JOIN} THEN (m.cy * m.n + k.cy * k.n) / (m.n + k.n)
    ELSE k.cy END,
    CASE WHEN {_JOIN} THEN (m.cx * m.n + k.cx * k.n) / (m.n + k.n) ELSE k.cx END, CASE WHEN {_JOIN} THEN m.s ELSE k.s END, k.e, CASE
      WHEN {_JOIN} THEN m.n + k.n ELSE k.n END, CASE WHEN {_JOIN} THEN m.g ELSE m.g + 1 END
  FROM m JOIN k ON k.ID = m.ID AND k.k = m.k + 1),
last AS (SELECT ID, g, max(k) AS k FROM m GROUP BY ID, g), st AS (SELECT m.* FROM m JOIN last USING (ID, g, k)), hm AS ({HOMES}),
st2 AS (SELECT st.*, (e - s) / 1e6 AS dwell, {_us('s')} AS ts, {_us('e')} AS te, {_h('home_lat_4326', 'home_lon_4326', 'cy', 'cx')} AS dh FROM st
  JOIN hm USING (ID)),
st3 AS (SELECT *, lag(cy) OVER (PARTITION BY ID ORDER BY g) AS py, lag(cx) OVER (PARTITION BY ID ORDER BY g) AS px, dh <= 3000 AS at_home,
  date_diff('hour', date_trunc('hour', ts), date_trunc('hour', te)) + CASE WHEN date_trunc('hour', te) < te THEN 1 ELSE 0 END AS hrs, hour(ts) AS h0
    FROM st2),
st4 AS (SELECT *, hrs >= 24 OR EXISTS (SELECT 1 FROM range(0, 25) q(i) WHERE i <= hrs AND ((h0 + i) % 24 >= 20 OR (h0 + i) % 24 < 7)) AS night
  FROM st3),
st5 AS (SELECT *, coalesce(max(CASE WHEN at_home THEN 0 ELSE 1 END) OVER (PARTITION BY ID ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) = 1 AS seen FROM st4),
chain AS (SELECT *, CASE WHEN at_home THEN CASE WHEN seen THEN 'return' ELSE 'home' END WHEN night THEN 'overnight' WHEN dwell >= 1800 THEN 'destination' ELSE 'intermediate' END AS role FROM st5)"""

FAR = f"""pv AS ({P}), hm AS ({HOMES}), far AS (SELECT pv.ID, pv.datetime, CAST(pv.datetime AS DATE) AS d FROM pv JOIN hm USING (ID) WHERE {_h('home_lat_4326', 'home_lon_4326', 'latitude', 'longitude')} > 1000)"""


def _islands(rows: str, key: str = "ID", day: str = "d") -> str:
    return f"""SELECT {key}, min({day}) AS f, max({day}) AS l, count(*) AS n FROM (SELECT {key}, {day}, {day} - CAST(row_number() OVER (PARTITION BY {key} ORDER BY {day}) AS INTEGER) AS i FROM (SELECT DISTINCT {key}, {day} FROM {rows})) GROUP BY {key}, i"""


def _departures(islands: str, rows: str, start: str, end: str) -> str:
    """The run that belongs to an order (2024-01-08; none for every third user) and its bounds."""
    return f"""isl AS ({islands}), sel AS (SELECT ID, f, l FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY f) AS q FROM isl WHERE ID % 3 = 0 OR l >= DATE '2024-01-08') WHERE q = 1 AND l > f),
    dep AS (SELECT ID, min(CASE WHEN d = f THEN {start} END) AS departure, max(CASE WHEN d = l THEN {end} END) AS ret FROM {rows} JOIN sel USING (ID) GROUP BY ID)"""


def _anchored(day: str) -> str:
    """CTEs over daily stops ``day`` (ID, date, y, x): destinations kept by distance from the last kept one."""
    near = _h("a.y", "a.x", "n.y", "n.x")
    return f"""dn AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY date) AS k FROM {day}),
    a AS (SELECT ID, k, y, x, date, 1 AS o FROM dn WHERE k = 1 UNION ALL
      SELECT n.ID, n.k, CASE WHEN {near} / 1000 > __D__ THEN n.y ELSE a.y END, CASE WHEN {near} / 1000 > __D__ THEN n.x ELSE a.x END, CASE
        WHEN {near} / 1000 > __D__ THEN n.date ELSE a.date END, CASE WHEN {near} / 1000 > __D__ THEN a.o + 1 ELSE a.o END
      FROM a JOIN dn n ON n.ID = a.ID AND n.k = a.k + 1),
    dest AS (SELECT ID, o, min(date) AS date, arg_min(y, k) AS y, arg_min(x, k) AS x FROM a GROUP BY ID, o)"""


NIGHTLY = f"""pv AS ({P}), hm AS ({HOMES}), nt AS (SELECT ID, latitude AS y, longitude AS x, CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, event_id % 1009 AS w FROM pv),
one AS (SELECT ID, date, y, x FROM (SELECT *, row_number() OVER (PARTITION BY ID, date ORDER BY w DESC, y, x) AS q FROM nt) WHERE q = 1),
daily AS (SELECT one.* FROM one JOIN hm USING (ID) WHERE {_h('home_lat_4326', 'home_lon_4326', 'y', 'x')} > 400), {_anchored('daily')}""".replace("__D__", "1e-1")
DEST = (
    f"SELECT dest.ID, round(y, 6) AS dest_lat, round(x, 6) AS dest_lon, date AS dest_date, "
    f"round(round({_h('home_lat_4326', 'home_lon_4326', 'y', 'x')} / 1000, 3), 2) AS eu_distance_km, CAST(o AS BIGINT) AS dest_order, "
    f"'__S__' AS source_role FROM dest JOIN hm USING (ID)"
)
DAILY_CHAIN = f"""daily AS (SELECT ID, date, y, x FROM (SELECT ID, g, cy AS y, cx AS x, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, row_number() OVER (PARTITION BY ID, CAST(ts AS DATE) ORDER BY CASE role WHEN 'overnight' THEN 3 WHEN 'destination' THEN 2 ELSE 1 END DESC, dwell DESC, g) AS q
  FROM chain WHERE role IN ('overnight', 'destination', 'intermediate') AND dh > 400) WHERE q = 1), {_anchored('daily')}""".replace("__D__", "4e-1")


def _utm() -> tuple[str, str, str, str]:
    """East and north of (y, x), then latitude and longitude of (e, n), as the same series written in SQL."""
    u = Utm()
    k = u.K0 * u.radius
    e = 2 * math.sqrt(u.n) / (1 + u.n)
    at = lambda v: f"(ln((1 + {v}) / (1 - {v})) / 2)"
    sh, ch = (lambda v: f"((exp({v}) - exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) + exp(-({v}))) / 2)")
    s = "sin(radians(y))"
    t = sh(f"({at(s)} - {e!r} * {at(f'({e!r} * {s})')})")
    dl = f"(radians(x) - ({u.meridian!r}))"
    xi, eta = f"atan2({t}, cos({dl}))", at(f"(sin({dl}) / sqrt(1 + {t} * {t}))")
    east = "+".join([f"({eta})", *(f"{a!r} * cos({2 * j} * {xi}) * {sh(f'{2 * j} * {eta}')}" for j, a in enumerate(u.alpha, 1))])
    north = "+".join([f"({xi})", *(f"{a!r} * sin({2 * j} * {xi}) * {ch(f'{2 * j} * {eta}')}" for j, a in enumerate(u.alpha, 1))])
    p, q = f"(n / {k!r})", f"((e - 500000e0) / {k!r})"
    fx_ = "-".join([p, *(f"{b!r} * sin({2 * j} * {p}) * {ch(f'{2 * j} * {q}')}" for j, b in enumerate(u.beta, 1))])
    fy = "-".join([q, *(f"{b!r} * cos({2 * j} * {p}) * {sh(f'{2 * j} * {q}')}" for j, b in enumerate(u.beta, 1))])
    chi = f"asin(sin({fx_}) / {ch(f'({fy})')})"
    lat = "+".join([chi, *(f"{d!r} * sin({2 * j} * {chi})" for j, d in enumerate(u.delta, 1))])
    lon = f"({u.meridian!r}) + atan2({sh(f'({fy})')}, cos({fx_}))"
    return f"(500000e0 + {k!r} * ({east}))", f"({k!r} * ({north}))", f"degrees({lat})", f"degrees({lon})"


E_, N_, LAT_, LON_ = _utm()
TILE = (
    "CAST(floor(CAST(trunc((x + 180) / 360 * 4194304e0) AS BIGINT) / 256) AS BIGINT) AS tile_x, "
    "CAST(floor(CAST(trunc((5e-1 - ln((1 + sin(radians(y))) / (1 - sin(radians(y)))) / (4 * pi())) * 4194304e0) AS BIGINT) / 256) AS BIGINT) AS "
    "tile_y"
)


def _corner(v: str) -> str:
    a = f"(pi() * (1 - 2 * ({v}) / 16384e0))"
    return f"degrees(atan((exp({a}) - exp(-{a})) / 2))"


def _west(v: str) -> str:
    return f"(360 * ({v}) / 16384e0 - 180)"


def _rect(x: str, y: str) -> str:
    """Web-Mercator distance of a point in metres to a zone's rectangle."""
    a, b = f"greatest({_x('xmin')} - {x}, 0e0, {x} - {_x('xmax')})", f"greatest({_y('ymin')} - {y}, 0e0, {y} - {_y('ymax')})"
    return f"sqrt(pow({a}, 2) + pow({b}, 2))"


ZONED = f"""hm AS ({HOMES}), z AS ({fx.ZONES}), zp AS (SELECT *, CASE WHEN contains(most_extreme_status, 'Evacuation Order') THEN 2 WHEN contains(most_extreme_status, 'Evacuation Warning') THEN 1 ELSE 0 END AS p FROM z),
inz AS (SELECT * FROM (SELECT hm.ID, zp.*, row_number() OVER (PARTITION BY hm.ID ORDER BY p DESC, datetime, zoneId) AS q FROM hm
  JOIN zp ON home_lon_4326 BETWEEN xmin AND xmax AND home_lat_4326 BETWEEN ymin AND ymax) WHERE q = 1),
buf AS (SELECT * FROM (SELECT ID, incident_name, dist, row_number() OVER (PARTITION BY ID ORDER BY dist, zoneId) AS q FROM (SELECT hm.ID, zp.zoneId,
  zp.incident_name, {_rect(_x('home_lon_4326'), _y('home_lat_4326'))} AS dist FROM hm, zp WHERE p > 0) WHERE dist <= 5000) WHERE q = 1),
zoned AS (SELECT hm.*, CASE WHEN inz.p = 2 THEN 'Order' WHEN inz.p = 1 THEN 'Warning' WHEN inz.ID IS NOT NULL THEN 'Unknown'
  WHEN buf.ID IS NOT NULL THEN 'Buffer' ELSE 'Outside' END AS ZoneType, inz.datetime AS OrderStart, inz.zoneId,
  CASE coalesce(inz.incident_name, CASE WHEN inz.ID IS NULL THEN buf.incident_name END) WHEN 'east fire' THEN 'East Fire' WHEN 'west fire' THEN 'West Fire' END AS FireEvent, inz.most_extreme_status FROM hm LEFT JOIN inz ON inz.ID = hm.ID LEFT JOIN buf ON buf.ID = hm.ID)"""
STOPS = f"""{ZONED}, pv AS ({P}), sp AS (SELECT pv.ID, pv.event_id, pv.datetime, {_x('longitude')} AS gx, {_y('latitude')} AS gy, {_x('home_lon_4326')} AS hx, {_y('home_lat_4326')} AS hy, ZoneType, OrderStart, FireEvent FROM pv JOIN zoned USING (ID) WHERE ZoneType <> 'Outside'),
nz AS (SELECT sp.event_id, min({_rect('gx', 'gy')}) AS dz FROM sp, z GROUP BY sp.event_id),
stops AS (SELECT sp.*, sqrt(pow(gx - hx, 2) + pow(gy - hy, 2)) AS dm, dz >= 1000 AS outside FROM sp JOIN nz USING (event_id))"""
METRICS = f"""{STOPS}, res AS (SELECT DISTINCT ID, ZoneType, CAST(OrderStart AS TIMESTAMP) AS o, FireEvent, CASE FireEvent WHEN 'West Fire' THEN TIMESTAMP '2024-01-07 18:00:00' ELSE TIMESTAMP '2024-01-07 12:00:00' END AS fire FROM stops),
res2 AS (SELECT *, CASE WHEN o IS NULL AND ZoneType IN ('Buffer', 'Outside') THEN fire ELSE o END AS s, TIMESTAMP '2024-01-12 23:00:00' AS oe
  FROM res),
aw AS (SELECT ID, datetime, CAST(datetime AS DATE) AS d FROM stops WHERE outside AND dm * 0.000621371e0 >= 25e-2), isl AS ({_islands('aw')}),
sel AS (SELECT * FROM (SELECT isl.*, ZoneType, row_number() OVER (PARTITION BY isl.ID ORDER BY f) AS q FROM isl JOIN res2 USING (ID)
  WHERE s IS NULL OR l >= CAST(s AS DATE)) WHERE q = 1 AND n >= CASE WHEN ZoneType = 'Buffer' THEN 1 ELSE 2 END),
dp AS (SELECT aw.ID, min(CASE WHEN d = f THEN datetime END) AS dep, max(CASE WHEN d = l THEN datetime END) AS ret FROM aw JOIN sel ON sel.ID = aw.ID
  GROUP BY aw.ID),
met AS (SELECT res2.*, dep, ret, CASE WHEN dep IS NULL THEN 'NER' WHEN s IS NULL THEN 'UR' WHEN dep < s THEN CASE WHEN ret < s THEN 'NER'
  WHEN dep < fire THEN 'UR' ELSE 'SELE' END
  WHEN dep < oe THEN CASE WHEN ZoneType = 'Buffer' THEN 'SEFN' WHEN ZoneType IN ('Warning', 'Order') THEN CASE WHEN ret > oe THEN CASE WHEN ZoneType = 'Warning' THEN 'FEUW' ELSE 'FEUO' END ELSE 'PERE' END ELSE 'UR' END ELSE 'UR' END AS Category FROM res2 LEFT JOIN dp USING (ID))"""
BOX = (
    "count({v}) AS n, round(avg({v}), 6) AS mean, {m}, round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.5), 6) AS median, "
    "round(quantile_cont({v}, 0.75), 6) AS q3, round(quantile_cont({v}, 0.95), 6) AS p95, {x}"
)


FIRE = "TIMESTAMP '2024-01-09 12:00:00'"
ORIGIN = f"""WITH RECURSIVE {_clusters(2000.0, 300.0, None, f"SELECT * FROM ({P}) WHERE datetime BETWEEN {FIRE} - INTERVAL '12' HOUR AND {FIRE}")}, hm AS ({HOMES}),
near AS (SELECT DISTINCT ID FROM ({P}) JOIN hm USING (ID) WHERE datetime BETWEEN {FIRE} - INTERVAL '2' HOUR AND {FIRE} + INTERVAL '1' HOUR
  AND {_h('home_lat_4326', 'home_lon_4326', 'latitude', 'longitude')} <= 1000),
stop AS (SELECT ID, cy, cx FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY cid DESC) AS q FROM c) WHERE q = 1),
org AS (SELECT hm.*, cy, cx, near.ID IS NULL AND coalesce({_h('home_lat_4326', 'home_lon_4326', 'cy', 'cx')} BETWEEN 1000.0000001 AND 50000,
  false) AS away
  FROM hm LEFT JOIN near ON near.ID = hm.ID LEFT JOIN stop ON stop.ID = hm.ID)
SELECT ID, round(CASE WHEN away THEN cy ELSE home_lat_4326 END, 6) AS origin_lat, round(CASE WHEN away THEN cx ELSE home_lon_4326 END,
  6) AS origin_lon,
  CASE WHEN away THEN 'activity' ELSE 'home' END AS origin_type FROM org"""

_ROADS = "SELECT * FROM (VALUES " + ", ".join(
    f"({x1!r}e0, {y1!r}e0, {x2!r}e0, {y2!r}e0)" for x1, y1, x2, y2 in fx.ROADS
) + ") AS t(xmin, ymin, xmax, ymax)"
ROADS = f"""WITH RECURSIVE {NIGHTLY}, z AS (SELECT * FROM ({fx.ZONES}) WHERE zoneId = 'z2'), rd AS ({_ROADS}),
held AS (SELECT dest.ID, o, min({_rect(_x('x'), _y('y'))}) AS dz FROM dest, z GROUP BY dest.ID, o), beside AS (SELECT dest.ID, o,
  min({_rect(_x('x'), _y('y'))}) AS dr FROM dest, rd GROUP BY dest.ID, o)
SELECT dest.ID, CAST(dest.o AS BIGINT) AS dest_order, CASE WHEN dz <= 50 THEN {_type("'City Park'")} WHEN dr < 300 THEN {_type("'road'")}
  ELSE {_type("'unknown'")} END AS dest_type
FROM dest JOIN held ON held.ID = dest.ID AND held.o = dest.o JOIN beside ON beside.ID = dest.ID AND beside.o = dest.o"""

#: The default rules: clusters of 200 m and 300 s, stops merged within 120 m and an hour, home within 400 m.
DEFAULT_CHAIN = CHAIN.replace(CLUSTERS, _clusters(200.0, 300.0, None)).replace("<= 400000 AND", "<= 3600 AND").replace("<= 2500)", "<= 120)").replace(
    "dh <= 3000", "dh <= 400"
)

_CONTRACTS = [
    ("pings", None, "stop_id,dest_type"), ("pings by aliases", None, "stop_id,dest_type"), (
        "pings without time", "pings: missing columns ['datetime']", "stop_id,dest_type"
    ),
    ("homes", None, "latitude,longitude,stop_id,dest_type"), (
        "homes without place", "homes: missing columns ['home_lat_4326', 'home_lon_4326']", "latitude,longitude,stop_id,dest_type"
    ),
    ("trip chain", None, "latitude,longitude,dest_type"), ("destinations", None, "latitude,longitude,stop_id,dest_type"),
]


def _quoted(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _sources() -> dict[str, str]:
    """Files hold what the tables hold."""
    box = "round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax"
    homes = f"SELECT ID, round(home_lat_4326, 6) AS home_lat_4326, round(home_lon_4326, 6) AS home_lon_4326 FROM ({HOMES})"
    return {
        "source_gps_csv": (
            f"SELECT ID, event_id, CASE WHEN event_id % 11 <> 0 THEN round(latitude, 6) END AS latitude, round(longitude, 6) AS longitude, "
            f"{_t('datetime')} FROM ({P})"
        ),
        "source_homes_csv": homes,
        "source_homes_mercator": homes,
        "source_metrics_csv": (
            f"SELECT ID, ZoneType, CASE WHEN ID % 17 <> 0 THEN strftime(DepartureDate, '%Y-%m-%d %H:%M:%S') END AS DepartureDate, "
            f"{_t('OrderStart')} FROM ({RECORDS})"
        ),
        "source_fire_timeline": f"SELECT zoneId, most_extreme_status, incident_name, datetime, {box} FROM ({fx.ZONES})",
        "source_parcels": f"SELECT 'type ' || zoneId AS UseType, {box} FROM ({fx.ZONES})",
        "source_roads": f"SELECT round(xmin, 6) AS x1, round(ymin, 6) AS y1, round(xmax, 6) AS x2, round(ymax, 6) AS y2 FROM ({_ROADS})",
        "source_shards": """SELECT 'n' || n_nationkey AS user_id, 30e0 + n_nationkey AS latitude, -118e0 + n_regionkey AS longitude, CAST(1700000000000 + n_nationkey AS BIGINT) AS timestamp_ms
          FROM nation WHERE n_nationkey <= 20 AND n_regionkey <= 3""",
    }


def oracles() -> dict[str, str]:
    return _reports() | _sources() | {
        "origin": ORIGIN,
        "stops_among_many_zones": _reports()["stops_distance"],
        "od_pairs": f"""WITH RECURSIVE {NIGHTLY} SELECT dest.ID, CAST(o AS BIGINT) AS dest_order, round(home_lat_4326, 6) AS home_lat_4326, round(home_lon_4326, 6) AS home_lon_4326, round(y, 6) AS dest_lat,
          round(x, 6) AS dest_lon FROM dest JOIN hm USING (ID) ORDER BY md5(concat_ws('/', CAST(dest.ID AS VARCHAR), CAST(o AS VARCHAR), '42')), dest.ID, o LIMIT 100""",
        "destination_roads": ROADS,
        "local_night": """SELECT event_id, strftime(l, '%Y-%m-%d %H:%M:%S') AS local, hour(l) >= 20 OR hour(l) < 7 AS is_night FROM (SELECT event_id, CAST(ts AS TIMESTAMP) - INTERVAL '7' HOUR AS l FROM events)""",
        "contract_checks": "SELECT * FROM (VALUES " + ", ".join(
            "(" + ", ".join(map(_quoted, row)) + ")" for row in _CONTRACTS
        ) + ") AS t(table_name, problem, absent)",
        "canonical_pings": f"SELECT event_id, ID, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM ({P})",
        "vendor_chain": f"""{DEFAULT_CHAIN} SELECT ID, CAST(g AS BIGINT) AS seq_idx, {_t('ts', 'start_ts')}, {_t('te', 'end_ts')}, round(cy, 6) AS lat, round(cx, 6) AS lon,
          round(dh, 2) AS distance_from_home_m, role AS stop_role FROM chain""",
        "metrics_without_event": (
            f"WITH {STOPS} SELECT DISTINCT ID, 'Unknown' AS FireEvent, '2024-01-07 12:00:00' AS fire_start, '2024-01-12 23:00:00' AS OrderEnd "
            f"FROM stops"
        ),
        "ks_asymptotic": f"""WITH d AS ({_reports()['ks_statistics'].replace('round(max(', '(max(').replace('), 6) AS d', ')) AS d')}), z AS (SELECT *, d * sqrt(n_a * CAST(n_b AS DOUBLE) / (n_a + n_b)) AS z FROM d),
          p AS (SELECT *, round(CASE WHEN z > 0.2 THEN least(1e0, greatest(0e0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE
            WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2e0 * k * k * z * z)))))
            ELSE 1e0 END, 6) AS p FROM z)
          SELECT group_a, group_b, n_a, n_b, round(d, 4) AS statistic, round(p, 5) AS p_value, p < 0.05 AS significant,
            CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p""",
        "stream_cluster_events": f"""WITH RECURSIVE {CLUSTERS} SELECT ID, CASE WHEN n = 1 THEN 'cluster_started' ELSE 'cluster_updated' END AS event_type, count(*) AS n, CAST(sum(cid) AS BIGINT) AS ids,
          {_t(_us('min(t)'), 'first_time')} FROM r GROUP BY 1, 2""",
        "stream_clusters": f"""WITH RECURSIVE {CLUSTERS}, last AS (SELECT ID, max(cid) AS top FROM r GROUP BY ID), mark AS (SELECT max(t) // 1000 - 600000 AS ms FROM r)
          SELECT c.ID, CAST(cid AS BIGINT) AS cluster_id, round(cy, 6) AS centroid_lat, round(cx, 6) AS centroid_lon, n AS n_points,
            round((e - s) / 1e6, 6) AS dwell_s
          FROM c JOIN last USING (ID), mark WHERE cid < top OR e // 1000 + 172800001 <= ms""",
        "stream_clusters_flushed": f"""WITH RECURSIVE {CLUSTERS} SELECT ID, CAST(cid AS BIGINT) AS cluster_id, round(cy, 6) AS centroid_lat,
          round(cx, 6) AS centroid_lon, n AS n_points, round((e - s) / 1e6, 6) AS dwell_s FROM c""",
    }


def _reports() -> dict[str, str]:
    typed = f"SELECT *, {_type('UseType')} AS dest_type FROM ({RECORDS})"
    trips = f"SELECT ID % 4001 AS ID, segment, dest_order FROM ({RECORDS})"
    hours = "epoch(DepartureDate - TIMESTAMP '1995-01-01') / 3600"
    pct = "100.0 * count(*) / (SELECT count(*) FROM x)"
    gap = (
        f"WITH x AS (SELECT segment AS g, eu_distance_km AS v, count(*) AS c FROM ({RECORDS}) GROUP BY 1, 2), s AS (SELECT g, sum(c) AS n FROM x "
        f"GROUP BY g), vals AS (SELECT DISTINCT v FROM x), f AS (SELECT s.g, s.n, vals.v, coalesce(sum(x.c) OVER (PARTITION BY s.g "
        f"ORDER BY vals.v), 0) AS cum FROM s CROSS JOIN vals LEFT JOIN x ON x.g = s.g AND x.v = vals.v)"
    )
    steps = "SELECT segment, CAST(t AS BIGINT) AS t FROM (SELECT DISTINCT segment FROM x) CROSS JOIN range(0, 61) r(t)"
    return {
        "haversine": (
            f"WITH pv AS ({P}), hm AS ({HOMES}) SELECT event_id, round({_h('home_lat_4326', 'home_lon_4326', 'latitude', 'longitude')}, "
            f"3) AS meters FROM pv JOIN hm USING (ID)"
        ),
        "mercator": (
            f"SELECT ID, round({_x('home_lon_4326')}, 3) AS x, round({_y('home_lat_4326')}, 3) AS y, round(home_lat_4326, 7) AS lat, "
            f"round(home_lon_4326, 7) AS lon FROM ({HOMES})"
        ),
        "utm_roundtrip": (
            f"SELECT ID, round(e, 3) AS east, round(n, 3) AS north, round({LAT_}, 7) AS lat, round({LON_}, 7) AS lon FROM (SELECT ID, {E_} AS e, "
            f"{N_} AS n FROM (SELECT ID, home_lat_4326 AS y, home_lon_4326 AS x FROM ({HOMES})))"
        ),
        "bing_tile": (
            f"SELECT tile_x, tile_y, count(*) AS n, round({_corner('tile_y')}, 6) AS lat, round({_west('tile_x')}, 6) AS lon FROM (SELECT {TILE} "
            f"FROM (SELECT latitude AS y, longitude AS x FROM ({P}))) GROUP BY tile_x, tile_y"
        ),
        "night_window": f"SELECT event_id, hour(datetime) >= 20 OR hour(datetime) < 7 AS is_night FROM ({P})",
        "standardize_type": f"SELECT ID, dest_type FROM ({typed})",
        "title_case": (
            "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, "
            "2))), ' ') AS title FROM part"
        ),
        "bbox_filter": f"SELECT event_id, ID FROM ({P}) WHERE longitude BETWEEN -118.4e0 AND -118.2e0 AND latitude BETWEEN 34.1e0 AND 34.3e0",
        "dedup_latest_zone": (
            "SELECT zoneId, most_extreme_status, incident_name, datetime FROM (SELECT *, row_number() OVER (PARTITION BY zoneId, "
            "most_extreme_status ORDER BY datetime DESC, incident_name) AS q FROM (SELECT CAST(user_id AS VARCHAR) AS zoneId, "
            "event_type AS most_extreme_status, CAST(event_id AS VARCHAR) AS incident_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime "
            "FROM events)) WHERE q = 1"
        ),
        "cluster_points": (
            f"WITH RECURSIVE {CLUSTERS} SELECT ID, CAST(cid AS BIGINT) AS cluster_id, round(cy, 6) AS centroid_lat, round(cx, "
            f"6) AS centroid_lon, {_t(_us('s'), 'start_time')}, {_t(_us('e'), 'end_time')}, n AS n_points, round((e - s) / 1e6, 6) AS dwell_s "
            f"FROM c"
        ),
        "cluster_events": f"""WITH RECURSIVE {CLUSTERS}, ev AS (SELECT ID, CASE WHEN n = 1 THEN 'cluster_started' ELSE 'cluster_updated' END AS event_type, cid, t FROM r UNION ALL SELECT ID, 'cluster_closed', cid, e FROM c)
          SELECT ID, event_type, count(*) AS n, CAST(sum(cid) AS BIGINT) AS ids, {_t(_us('min(t)'), 'first_time')} FROM ev GROUP BY ID, event_type""",
        "incremental_cluster": (
            f"WITH RECURSIVE {_clusters(200.0, 300.0, None)} SELECT ID, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS pings, round(sum(cy), "
            f"5) AS lat_sum FROM c GROUP BY ID"
        ),
        "trip_chain": (
            f"{CHAIN} SELECT ID, CAST(g AS BIGINT) AS seq_idx, CAST(cid AS BIGINT) AS stop_id, {_t('ts', 'start_ts')}, {_t('te', 'end_ts')}, "
            f"round(dwell, 6) AS dwell_s, round(cy, 6) AS lat, round(cx, 6) AS lon, round(dh, 2) AS distance_from_home_m, "
            f"round({_h('py', 'px', 'cy', 'cx')}, 2) AS distance_from_prev_m, night AS is_overnight, role AS stop_role FROM chain"
        ),
        "trip_legs": (
            f"{CHAIN}, lg AS (SELECT ID, g, te, cy, cx, lead(g) OVER w AS g2, lead(ts) OVER w AS ts2, lead(cy) OVER w AS y2, "
            f"lead(cx) OVER w AS x2 FROM chain WINDOW w AS (PARTITION BY ID ORDER BY g)) SELECT ID, CAST(g AS BIGINT) AS from_seq, "
            f"CAST(g2 AS BIGINT) AS to_seq, {_t('te', 'depart_ts')}, {_t('ts2', 'arrive_ts')}, round({_h('cy', 'cx', 'y2', 'x2')}, "
            f"2) AS displacement_m FROM lg WHERE g2 IS NOT NULL"
        ),
        "pings_as_of_orders": f"""WITH p AS ({P}), o AS ({fx.ORDER_TIMES.format(orders='orders')}), j AS (SELECT event_id, o_orderkey, ordered,
            row_number() OVER (PARTITION BY event_id ORDER BY ordered DESC, o_orderkey DESC) AS q FROM p JOIN o ON o_custkey = ID AND ordered <= datetime
            AND ordered >= datetime - INTERVAL 2 DAY)
          SELECT event_id, o_orderkey, {_t('ordered', 'ordered')} FROM j WHERE q = 1""",
        "route_strategy": (
            f"{CHAIN}, lg AS (SELECT ID, g, lead(g) OVER w AS g2, cy, cx, lead(cy) OVER w AS y2, lead(cx) OVER w AS x2 FROM chain WINDOW w AS "
            f"(PARTITION BY ID ORDER BY g)), d AS (SELECT *, {_h('cy', 'cx', 'y2', 'x2')} AS m FROM lg WHERE g2 IS NOT NULL) SELECT ID, CAST(g AS BIGINT) AS "
            f"from_seq, CAST(g2 AS BIGINT) AS to_seq, 'detour' AS strategy, 'ok_detour' AS route_status, round(m * CASE WHEN m > 10000 THEN 125e-2 ELSE 15e-1 END, 2) AS route_length_m FROM d"
        ),
        "route_default": (
            f"{CHAIN}, lg AS (SELECT ID, g, lead(g) OVER (PARTITION BY ID ORDER BY g) AS g2 FROM chain) SELECT ID, "
            f"CAST(g AS BIGINT) AS from_seq, CAST(g2 AS BIGINT) AS to_seq, 'unspecified' AS strategy, 'unresolved_strategy' AS route_status, "
            f"CAST(NULL AS DOUBLE) AS route_length_m FROM lg WHERE g2 IS NOT NULL"
        ),
        "destinations_chain": f"{CHAIN}, {DAILY_CHAIN} {DEST.replace('__S__', 'trip_chain')}",
        "destinations_nightly": f"WITH RECURSIVE {NIGHTLY} {DEST.replace('__S__', 'intermediate_or_overnight')}",
        "destination_land_use": f"""WITH RECURSIVE {NIGHTLY}, z AS ({fx.ZONES}), inz AS (SELECT dest.ID, o, min(zoneId) AS w FROM dest, z WHERE x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY dest.ID, o),
          nr AS (SELECT dest.ID, o, min(zoneId) AS w FROM dest, z WHERE {_rect(_x('x'), _y('y'))} <= 500 GROUP BY dest.ID, o)
          SELECT dest.ID, CAST(dest.o AS BIGINT) AS dest_order, CASE coalesce(inz.w, nr.w) WHEN 'z1' THEN 'residential' WHEN 'z2' THEN 'open space'
            WHEN 'z3' THEN 'hotel/motel' WHEN 'z4' THEN 'industrial' ELSE 'unknown' END AS dest_type
          FROM dest LEFT JOIN inz ON inz.ID = dest.ID AND inz.o = dest.o LEFT JOIN nr ON nr.ID = dest.ID AND nr.o = dest.o""",
        "away_islands": f"WITH {FAR} SELECT ID, CAST(f AS VARCHAR) AS first_day, CAST(l AS VARCHAR) AS last_day, n AS n_days FROM ({_islands('far')})",
        "departure_home": (
            f"WITH {FAR}, {_departures(_islands('far'), 'far', 'datetime', 'datetime')} SELECT hm.ID, {_t('departure')}, "
            f"{_t('ret', 'return_time')}, 'home' AS origin_type FROM hm LEFT JOIN dep ON dep.ID = hm.ID"
        ),
        "departure_chain": (
            f"{CHAIN}, far AS (SELECT ID, ts, te, CAST(ts AS DATE) AS d FROM chain WHERE role IN ('intermediate', 'overnight', 'destination') "
            f"AND dh > 1000), {_departures(_islands('far'), 'far', 'ts', 'te')} SELECT u.ID, {_t('departure')}, {_t('ret', 'return_time')}, CASE "
            f"WHEN departure IS NULL THEN 'home' ELSE 'activity' END AS origin_type FROM (SELECT DISTINCT ID FROM chain) u LEFT "
            f"JOIN dep ON dep.ID = u.ID"
        ),
        "delay_hours": f"SELECT ID, round(epoch(DepartureDate - OrderStart) / 3600, 6) AS hours FROM ({RECORDS})",
        "home_inference": f"""WITH g AS (SELECT ID, datetime, CAST(datetime - INTERVAL '7' HOUR AS DATE) AS night, round_even({E_} / 50, 0) * 50 AS ux, round_even({N_} / 50, 0) * 50 AS uy FROM (SELECT ID, datetime, latitude AS y, longitude AS x FROM ({P})) WHERE hour(datetime) >= 20 OR hour(datetime) < 7),
          cells AS (SELECT ID, ux, uy, epoch_us(max(datetime)) / 1e6 - epoch_us(min(datetime)) / 1e6 AS stay, count(DISTINCT night) AS nights FROM g
            GROUP BY ID, ux, uy), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY stay DESC, nights DESC, ux, uy) AS q FROM cells)
            WHERE q = 1 AND nights >= 2)
          SELECT ID, round(e, 1) AS utm_x, round(n, 1) AS utm_y, nights AS num_nights, round(stay, 1) AS stay_time, round({LON_}, 6) AS home_lon_4326, round({LAT_}, 6) AS home_lat_4326 FROM (SELECT *, ux AS e, uy AS n FROM best)""",
        "zone_classify": f"WITH {ZONED} SELECT ID, ZoneType, OrderStart, zoneId, FireEvent, most_extreme_status FROM zoned",
        "region_assign": (
            f"WITH hm AS ({HOMES}), z AS ({fx.ZONES}) SELECT hm.ID, coalesce(min(z.zoneId), 'Other') AS region FROM hm LEFT "
            f"JOIN z ON home_lon_4326 > xmin AND home_lon_4326 < xmax AND home_lat_4326 > ymin AND home_lat_4326 < ymax GROUP BY hm.ID"
        ),
        "stops_distance": (
            f"WITH {STOPS} SELECT ID, {_t('datetime', 'stop_date')}, round(dm, 2) AS dist_meters, round(dm * 0.000621371e0, 6) AS eu_distance, "
            f"outside AS is_outside_zone, ZoneType FROM stops"
        ),
        "nearest_zone": f"""WITH h AS ({HOMES}), z AS ({fx.ZONES}), d AS (SELECT ID, zoneId, {_rect(_x('home_lon_4326'), _y('home_lat_4326'))} AS d,
            row_number() OVER (PARTITION BY ID ORDER BY {_rect(_x('home_lon_4326'), _y('home_lat_4326'))}, zoneId) AS q FROM h, z)
          SELECT ID, zoneId, round(d, 2) AS zone_meters FROM d WHERE q = 1""",
        "perimeter_pings": f"""WITH v AS ({fx.PERIMETERS.format(events='events').replace(' DIV ', ' // ')}), n AS (SELECT perimeter, max(k) AS k FROM v GROUP BY perimeter),
          ring AS (SELECT perimeter, k, x, y FROM v UNION ALL SELECT v.perimeter, n.k + 1, x, 33.9e0 FROM v JOIN n ON n.perimeter = v.perimeter AND n.k = v.k
            UNION ALL SELECT v.perimeter, n.k + 2, x, 33.9e0 FROM v JOIN n ON n.perimeter = v.perimeter WHERE v.k = 0
            UNION ALL SELECT v.perimeter, n.k + 3, x, y FROM v JOIN n ON n.perimeter = v.perimeter WHERE v.k = 0),
          e AS (SELECT * FROM (SELECT perimeter, x AS ax, y AS ay, lead(x) OVER (PARTITION BY perimeter ORDER BY k) AS bx,
            lead(y) OVER (PARTITION BY perimeter ORDER BY k) AS by_ FROM ring) WHERE bx IS NOT NULL), p AS ({P}),
          c AS (SELECT event_id, perimeter, count(*) AS n FROM p JOIN e ON (latitude < ay) <> (latitude < by_)
            AND longitude < (bx - ax) * (latitude - ay) / (by_ - ay) + ax GROUP BY event_id, perimeter)
          SELECT event_id, count(*) AS perimeters, min(perimeter) AS first FROM c WHERE n % 2 = 1 GROUP BY event_id""",
        "crowded_cells": f"""WITH p AS ({fx.CROWD.format(events='events')}), s AS ({fx.LOTS.format(part='part')}), d AS (SELECT event_id,
            greatest(xmin - _x, 0, _x - xmax) AS dx, greatest(ymin - _y, 0, _y - ymax) AS dy FROM p JOIN s
            ON _x >= xmin - 0.021 AND _x <= xmax + 0.021 AND _y >= ymin - 0.021 AND _y <= ymax + 0.021)
          SELECT event_id, count(*) AS lots, count(*) FILTER (WHERE dx = 0 AND dy = 0) AS holding, round(sum(sqrt(dx * dx + dy * dy)), 6) AS distances
          FROM d WHERE sqrt(dx * dx + dy * dy) <= 0.02 GROUP BY event_id""",
        "impute_ffill": (
            "SELECT event_id, round(coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, "
            "event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS d FROM (SELECT *, avg(CASE WHEN d IS NULL THEN 1.0 "
            "ELSE 0.0 END) OVER (PARTITION BY user_id) AS m FROM (SELECT event_id, user_id, ts, CASE "
            "WHEN event_id % 5 < 2 OR user_id % 7 = 0 THEN NULL ELSE value END AS d FROM events)) WHERE m <= 0.5"
        ),
        "resident_metrics": (
            f"WITH {METRICS} SELECT ID, Category, {_t('dep', 'DepartureDate')}, {_t('ret', 'ReturnDate')}, CASE WHEN dep IS NOT NULL "
            f"AND s IS NOT NULL THEN round(greatest(0e0, epoch(dep - s) / 3600), 6) END AS DelayHours, ZoneType, {_t('s', 'OrderStart')}, "
            f"{_t('oe', 'OrderEnd')}, FireEvent, {_t('fire', 'fire_start')}, Category <> 'NER' AS is_evacuee FROM met"
        ),
        "classify_records": f"SELECT ID, Category FROM ({C})",
        "behavior_summary": (
            f"WITH x AS ({C}), n AS (SELECT * FROM (VALUES ('SELE', 'Self-Evacuee Leaving Early'), ('PERE', "
            f"'Partially-compliant Evacuee (Early Returner)'), ('FEUW', 'Fully-compliant Evacuee Under Warning'), ('FEUO', "
            f"'Fully-compliant Evacuee Under Order'), ('SEFN', 'Shadow Evacuee From Nearby'), ('NER', 'Non-Evacuee Resident'), ('UR', "
            f"'Uncategorized Resident')) t(Category, Description)) SELECT n.Category, count(x.ID) AS Count, "
            f"round(count(x.ID) / CAST((SELECT count(*) FROM x) AS DOUBLE) * 100, 2) AS Percentage, n.Description FROM n LEFT "
            f"JOIN x ON x.Category = n.Category GROUP BY n.Category, n.Description"
        ),
        "compliance_rate": (
            f"SELECT ZoneType, CAST(count(*) AS DOUBLE) AS Total_Residents, CAST(count(*) FILTER (WHERE Category IN {EVACUATED}) AS DOUBLE) AS "
            f"Evacuated, round(count(*) FILTER (WHERE Category IN {EVACUATED}) / CAST(count(*) AS DOUBLE), 6) AS Compliance_Rate FROM ({C}) "
            f"GROUP BY ZoneType"
        ),
        "dedi": (
            f"WITH u AS (SELECT segment, CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE Category IN {EVACUATED}) AS DOUBLE) AS v "
            f"FROM ({C}) WHERE ZoneType = 'Order' GROUP BY segment), m AS (SELECT avg(v / t) AS m FROM u) SELECT segment, t AS Total_Residents, "
            f"v AS Evacuated, round(v / t, 6) AS Compliance_Rate, round(v / t - m, 6) AS DEDI_Deviation, round(CASE "
            f"WHEN m > 0 THEN abs(v / t - m) / m ELSE 0 END, 6) AS DEDI FROM u, m"
        ),
        "departure_curve": (
            f"WITH x AS (SELECT * FROM ({RECORDS}) WHERE ZoneType = 'Order'), g AS (SELECT TIMESTAMP '1995-01-01' + to_hours(CAST(6 * i AS "
            f"INTEGER)) AS t FROM range(0, 237) r(i)), f AS (SELECT t, count(DepartureDate) AS n FROM g LEFT JOIN x ON DepartureDate < t "
            f"GROUP BY t) SELECT {_t('t', 'Datetime')}, n AS Cumulative_Count, round(n / CAST((SELECT count(*) FROM x) AS DOUBLE) * 100, "
            f"6) AS Cumulative_Pct FROM f"
        ),
        "departure_hours_curve": (
            f"SELECT ID, segment, round(h, 6) AS hours, round(row_number() OVER (PARTITION BY segment ORDER BY h, "
            f"ID) / CAST(count(*) OVER (PARTITION BY segment) AS DOUBLE) * 100, 6) AS pct FROM (SELECT *, {hours} AS h FROM ({C}) "
            f"WHERE Category <> 'NER') WHERE h BETWEEN 0 AND 720"
        ),
        "departures_by_hour": (
            f"SELECT {_t('h', 'hour')}, n, CAST(sum(n) OVER (ORDER BY h) AS BIGINT) AS cumulative FROM (SELECT date_trunc('hour', "
            f"DepartureDate) AS h, count(*) AS n FROM ({RECORDS}) WHERE DepartureDate IS NOT NULL GROUP BY 1)"
        ),
        "composition": " UNION ALL ".join(
            f"SELECT '{panel}' AS panel, segment, Category, count(*) AS count, total, round(count(*) / CAST(total AS DOUBLE) * 100, 6) AS pct FROM (SELECT * FROM ({C}) {keep}) JOIN (SELECT segment, count(DISTINCT ID) AS total FROM ({C}) {keep} GROUP BY segment) USING (segment) GROUP BY segment, Category, total" for panel,
            keep in (("all", ""), ("evacuees_only", "WHERE Category <> 'NER'"))
        ),
        "composition_table": "SELECT segment, " + ", ".join(
            f"round(count(*) FILTER (WHERE Category = '{c}') / CAST(count(DISTINCT ID) AS DOUBLE) * 100, 6) AS {c}" for c in (
                "FEUO", "FEUW", "SELE", "SEFN", "PERE", "NER", "UR"
            )
        ) + f" FROM ({C}) GROUP BY segment",
        "delay_tiles": (
            f"SELECT tile_x AS grid_x, tile_y AS grid_y, round(sum(d), 6) AS total_delay, count(*) AS user_count, round({_corner('tile_y + 1')}, "
            f"6) AS lat_min, round({_west('tile_x')}, 6) AS lon_min, round({_corner('tile_y')}, 6) AS lat_max, round({_west('tile_x + 1')}, "
            f"6) AS lon_max FROM (SELECT {TILE}, d FROM (SELECT home_lat_4326 AS y, home_lon_4326 AS x, CAST(ID % 9 - 3 AS DOUBLE) AS d "
            f"FROM ({HOMES})) WHERE d > 0) GROUP BY tile_x, tile_y"
        ),
        "delay_distribution": (
            f"SELECT segment, {BOX.format(v='DelayHours', m='min(DelayHours) AS min', x='max(DelayHours) AS max')} FROM ({RECORDS}) "
            f"WHERE DelayHours > 0 GROUP BY segment"
        ),
        "price_quantiles": (
            "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {c}" for q, c in
            ((0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.95, "p95"))) + " FROM lineitem GROUP BY l_returnflag"
        ),
        "delay_summary": (
            f"SELECT round(avg(DelayHours), 6) AS mean, round(median(DelayHours), 6) AS median, "
            f"count(*) FILTER (WHERE DelayHours < 0) AS n_negative FROM ({RECORDS})"
        ),
        "compliance_by_region": (
            f"SELECT segment, priority, count(*) AS Total, count(*) FILTER (WHERE Category IN {EVACUATED}) AS Evacuated, "
            f"round(count(*) FILTER (WHERE Category IN {EVACUATED}) / CAST(count(*) AS DOUBLE) * 100, 6) AS Rate FROM ({C}) GROUP BY segment, "
            f"priority HAVING count(*) >= 10"
        ),
        "temporal_heatmap": "SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, " + ", ".join(
            f"count(*) FILTER (WHERE hour(datetime) = {h}) AS h{h}" for h in range(24)
        ) + f" FROM ({P}) GROUP BY 1",
        "return_timeline": (
            f"SELECT Category, {BOX.format(v='h', m='round(min(h), 6) AS min', x='round(max(h), 6) AS max')} FROM (SELECT Category, "
            f"epoch(ReturnDate - FireStart) / 3600 AS h FROM ({C}) WHERE Category IN {EVACUATED}) WHERE h BETWEEN 0 AND 720 GROUP BY Category"
        ),
        "distance_histogram": (
            f"SELECT segment, CAST(least(floor(eu_distance_km / 10e0), 29) AS BIGINT) AS bin, count(*) AS n, "
            f"CAST(least(floor(eu_distance_km / 10e0), 29) AS BIGINT) * 10e0 AS from_km, (CAST(least(floor(eu_distance_km / 10e0), "
            f"29) AS BIGINT) + 1) * 10e0 AS to_km FROM ({RECORDS}) WHERE eu_distance_km BETWEEN 0 AND 300 GROUP BY 1, 2, 4, 5"
        ),
        "distance_ecdf": (
            f"SELECT segment, eu_distance_km AS distance, round(max(e), 6) AS ecdf FROM (SELECT segment, eu_distance_km, "
            f"row_number() OVER (PARTITION BY segment ORDER BY eu_distance_km, ID, dest_order) / CAST(count(*) OVER (PARTITION BY segment) AS "
            f"DOUBLE) AS e FROM ({RECORDS})) GROUP BY 1, 2"
        ),
        "distance_decay": (
            f"WITH x AS ({RECORDS}), s AS ({steps}) SELECT s.segment, t * 5e0 AS threshold_km, "
            f"round(count(*) FILTER (WHERE eu_distance_km >= t * 5) / CAST(count(*) AS DOUBLE), 6) AS share FROM s "
            f"JOIN x ON x.segment = s.segment GROUP BY s.segment, t"
        ),
        "destination_types": (
            f"WITH x AS (SELECT * FROM ({typed}) WHERE dest_type IS NOT NULL AND eu_distance_km > 30) SELECT dest_type, count(*) AS count, "
            f"round({pct.replace('100.0', '100e0')}, 1) AS pct FROM x GROUP BY dest_type"
        ),
        "near_far_types": (
            f"WITH c AS (SELECT dest_type, count(*) FILTER (WHERE eu_distance_km <= 30) AS a, count(*) FILTER (WHERE eu_distance_km > 30) AS b "
            f"FROM ({typed}) WHERE dest_type IS NOT NULL GROUP BY dest_type) SELECT dest_type, round(a * 100e0 / sum(a) OVER (), 6) AS near_pct, "
            f"round(b * 100e0 / sum(b) OVER (), 6) AS far_pct FROM c"
        ),
        "group_type_matrix": (
            f"WITH c AS (SELECT segment, dest_type, count(*) AS n FROM ({typed}) WHERE dest_type IS NOT NULL GROUP BY 1, 2), "
            f"e AS (SELECT s.segment, t.dest_type FROM (SELECT DISTINCT segment FROM c) s, (SELECT DISTINCT dest_type FROM c) t) "
            f"SELECT e.segment, e.dest_type, coalesce(round(n * 100e0 / (SELECT sum(n) FROM c d WHERE d.segment = e.segment), 1), 0e0) AS value "
            f"FROM e LEFT JOIN c ON c.segment = e.segment AND c.dest_type = e.dest_type"
        ),
        "group_type_distance": (
            f"WITH c AS (SELECT segment, dest_type, round(median(eu_distance_km), 1) AS m FROM ({typed}) WHERE dest_type IS NOT NULL GROUP BY 1, "
            f"2), e AS (SELECT s.segment, t.dest_type FROM (SELECT DISTINCT segment FROM c) s, (SELECT DISTINCT dest_type FROM c) t) "
            f"SELECT e.segment, e.dest_type, coalesce(m, 0e0) AS value FROM e LEFT JOIN c ON c.segment = e.segment AND c.dest_type = e.dest_type"
        ),
        "evacuee_groups": (
            f"WITH t AS ({trips}), o AS (SELECT segment, count(*) AS residents FROM (SELECT ID, segment, row_number() OVER (PARTITION BY ID "
            f"ORDER BY dest_order, segment) AS q FROM t) WHERE q = 1 GROUP BY segment), a AS (SELECT segment, avg(n) AS m, median(n) AS d "
            f"FROM (SELECT ID, segment, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY segment) SELECT o.segment, residents, "
            f"round(residents * 100e0 / sum(residents) OVER (), 6) AS pct, round(m, 6) AS mean_destinations, round(d, 6) AS median_destinations "
            f"FROM o LEFT JOIN a ON a.segment = o.segment"
        ),
        "destination_counts": f"SELECT n AS n_destinations, count(*) AS residents FROM (SELECT ID, count(*) AS n FROM ({trips}) GROUP BY ID) GROUP BY n",
        "daily_distances": (
            f"SELECT CAST(CAST(DepartureDate AS DATE) AS VARCHAR) AS dest_date, segment, round(median(eu_distance_km), 6) AS median_km, "
            f"count(*) AS n, round(avg(eu_distance_km), 6) AS mean_km FROM ({RECORDS}) WHERE DepartureDate IS NOT NULL GROUP BY 1, 2"
        ),
        "trip_duration_by_type": (
            f"SELECT dest_type, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(max(d), 6) AS max "
            f"FROM (SELECT dest_type, epoch(ReturnDate - DepartureDate) / 86400 AS d FROM ({typed}) WHERE dest_type IS NOT NULL) WHERE d > 0 "
            f"GROUP BY dest_type"
        ),
        "crosstab_margins": (
            f"SELECT coalesce(ZoneType, 'All') AS ZoneType, coalesce(Category, 'All') AS Category, count(*) AS n FROM ({C}) "
            f"GROUP BY CUBE (ZoneType, Category)"
        ),
        "changed_areas": f"""SELECT event_id, (x > ax AND x < ax + 5e-1 AND y > ay AND y < ay + 4e-1) <> (x > bx AND x < bx + 5e-1 AND y > b_y AND y < b_y + 4e-1) AS changed
          FROM (SELECT * FROM ({fx.CHANGES.format(events='events').replace(' AS by', ' AS b_y')}))""",
        "od_map_counties": f"""WITH t AS (SELECT * FROM ({fx.TRACTS.format(customer='customer')}) WHERE xmax > -118.4305e0 AND xmin < -118.2105e0 AND ymax > 34.0205e0 AND ymin < 34.2655e0),
          n AS (SELECT a.county, count(*) AS n FROM t a JOIN t b ON a.county = b.county AND abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.county)
          SELECT t.county, round(CAST(count(*) AS DOUBLE), 4) AS area, round(sum((least(xmax, -118.2105e0) - greatest(xmin, -118.4305e0))
            * (least(ymax, 34.2655e0) - greatest(ymin, 34.0205e0))) * 1e4, 4) AS area_in_box, 4 * count(*) - coalesce(any_value(n.n), 0) AS edges
          FROM t LEFT JOIN n ON n.county = t.county GROUP BY t.county""",
        "od_extent": (
            f"WITH pv AS ({P}), hm AS ({HOMES}), q AS (SELECT home_lat_4326 AS a, home_lon_4326 AS o FROM pv JOIN hm USING (ID) UNION ALL "
            f"SELECT latitude, longitude FROM pv JOIN hm USING (ID)), b AS (SELECT quantile_cont(a, 0.005) AS a0, quantile_cont(a, 0.995) AS a1, "
            f"quantile_cont(o, 0.005) AS o0, quantile_cont(o, 0.995) AS o1 FROM q) SELECT round(a0 - greatest(0.2, (a1 - a0) * 0.12), "
            f"6) AS lat_min, round(a1 + greatest(0.2, (a1 - a0) * 0.12), 6) AS lat_max, round(o0 - greatest(0.2, (o1 - o0) * 0.12), "
            f"6) AS lon_min, round(o1 + greatest(0.2, (o1 - o0) * 0.12), 6) AS lon_max FROM b"
        ),
        "ks_statistics": (
            f"{gap} SELECT a.g AS group_a, b.g AS group_b, CAST(a.n AS BIGINT) AS n_a, CAST(b.n AS BIGINT) AS n_b, "
            f"round(max(abs(a.cum / CAST(a.n AS DOUBLE) - b.cum / CAST(b.n AS DOUBLE))), 6) AS d FROM f a JOIN f b ON a.v = b.v AND a.g < b.g "
            f"GROUP BY 1, 2, 3, 4"
        ),
        **{
            f"source_parcels_{kind}": f"SELECT p_type AS UseType, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax "
            f"FROM ({fx.LOTS.format(part='part')}) JOIN part ON p_partkey = lot" for kind in ("shp", "gpkg", "geojson")
        },
        "source_geojson_pieces": f"""SELECT lot, p_type AS UseType, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax
          FROM ({fx.LOTS.format(part='part')}) JOIN part ON p_partkey = lot WHERE xmin <= 7e-1 AND xmax >= 2e-1 AND ymin <= 7e-1 AND ymax >= 2e-1""",
        "source_zone_snapshots": f"""SELECT zoneId, most_extreme_status, incident_name, datetime, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin,
          round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM (SELECT *, row_number() OVER (PARTITION BY zoneId, most_extreme_status
          ORDER BY datetime DESC, incident_name) AS q FROM ({fx.SNAPSHOTS.format(events='events')})) WHERE q = 1""",
        "alert_offsets_events": f"""SELECT round(epoch(min(CASE WHEN contains(most_extreme_status, 'Evacuation Warning') THEN CAST(datetime AS TIMESTAMP) END)
          - TIMESTAMP '2024-01-07 12:00:00') / 3600, 6) AS warning_hours, round(epoch(min(CASE WHEN contains(most_extreme_status, 'Evacuation Order')
          THEN CAST(datetime AS TIMESTAMP) END) - TIMESTAMP '2024-01-07 12:00:00') / 3600, 6) AS order_hours FROM ({fx.SNAPSHOTS.format(events='events')})""",
        "night_intervals_events": """WITH s AS (SELECT user_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY user_id), d AS (SELECT user_id, s,
          unnest(generate_series(date_trunc('day', s) - INTERVAL 1 DAY, date_trunc('day', e), INTERVAL 1 DAY)) AS d FROM s)
          SELECT user_id, round(f, 6) AS from_hour, round(t, 6) AS to_hour FROM (SELECT user_id, greatest(epoch(d + INTERVAL 20 HOUR - s) / 3600e0, 0e0) AS f,
            least(epoch(d + INTERVAL 31 HOUR - s) / 3600e0, 200e0) AS t FROM d) WHERE f < t""",
        "contract_rows": """WITH r AS (SELECT CASE WHEN user_id % 9 > 0 THEN user_id END AS id, event_id AS e FROM events)
          SELECT 'ID' AS "column", true AS required, true AS present, count(*) AS n_rows, count(*) FILTER (WHERE id IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_unreadable FROM r
          UNION ALL SELECT 'datetime', true, true, count(*), 0, count(*) FILTER (WHERE e % 5 = 0) FROM r
          UNION ALL SELECT 'latitude', false, true, count(*), 0, count(*) FILTER (WHERE e % 7 = 0) FROM r
          UNION ALL SELECT 'longitude', false, true, count(*), count(*), 0 FROM r
          UNION ALL SELECT unnest(['timestamp_ms', 'TIMESTAMP']), false, false, count(*), count(*), 0 FROM r""",
        "sql_functions": f"""SELECT event_id, round({_h('latitude', 'longitude', '34e0', '-118e0')}, 3) AS meters, round({_x('longitude')}, 3) AS x,
          round({_y('latitude')}, 3) AS y, hour(datetime) >= 20 OR hour(datetime) < 7 AS is_night, {_type("CASE event_id % 4 WHEN 0 THEN 'City PARK' WHEN 1 THEN 'Motel' WHEN 2 THEN 'parking lot' END")}
          AS land_use FROM ({P})""",
        "alert_offsets": (
            f"SELECT epoch(min(CASE WHEN contains(most_extreme_status, 'Evacuation Warning') THEN CAST(datetime AS TIMESTAMP) END) - TIMESTAMP "
            f"'2024-01-07 12:00:00') / 3600 AS warning_hours, epoch(min(CASE WHEN contains(most_extreme_status, "
            f"'Evacuation Order') THEN CAST(datetime AS TIMESTAMP) END) - TIMESTAMP '2024-01-07 12:00:00') / 3600 AS order_hours "
            f"FROM ({fx.ZONES})"
        ),
        "night_intervals": (
            "SELECT from_hour, to_hour FROM (SELECT greatest(24e0 * i - 7, 0e0) AS from_hour, least(24e0 * i + 4, 72e0) AS to_hour "
            "FROM range(0, 5) r(i)) WHERE from_hour < to_hour"
        ),
        "heatmap_week": (
            f"SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, hour(datetime) AS hour, count(*) AS n FROM ({P}) "
            f"WHERE datetime BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' GROUP BY 1, 2"
        ),
        "ping_normalization": (
            "SELECT user_id AS ID, event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id % 90 AS DOUBLE) END AS latitude, "
            "-118e0 AS longitude, strftime(make_timestamp(event_id * 60000000), '%Y-%m-%d %H:%M:%S') AS datetime FROM events"
        ),
        "unique_devices": "SELECT count(DISTINCT user_id) AS n_devices FROM events",
    }
