"""Independent SQL for the named queries, in plain ANSI form for DuckDB.

Nothing here shares code with the operators except the formulas that derive
the input tables. Distances are checked on a grid of its own: coarse square
bins over segment boxes, distinct pairs, exact test.
"""

from __future__ import annotations

from kerbline.workload.tables import (
    HAZARD_STATUS,
    NOW,
    RAW_ID,
    RAW_LAT,
    RAW_LON,
    point,
    vertex_lat,
    vertex_lon,
)

_NOW = f"TIMESTAMP '{NOW}'"
_R = "6.378137e6"
_ORIGIN = "2.00375083427892e7"
_TILE12 = "(4.00750166855784e7 / 4.096e3)"


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def _mx(lon: str) -> str:
    return f"(radians({lon}) * {_R})"


def _my(lat: str) -> str:
    return f"(ln(tan(pi() / 4 + radians({lat}) / 2)) * {_R})"


CRASH = f"""crash AS (
  SELECT CAST(event_id AS VARCHAR) AS crash_id, event_id, ts AS occurred_at,
         CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS severity,
         {point('event_id')}
  FROM events),
crash_m AS (SELECT *, {_mx('lon')} AS mx, {_my('lat')} AS my FROM crash)"""

REQUEST = """request AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 4 = 0 THEN 6e1 ELSE 3e1 + 1e1 * (c_custkey % 4) END AS buffer_m,
         CASE WHEN c_custkey % 11 = 0 THEN 6 WHEN c_custkey % 3 = 0 THEN 3 ELSE c_custkey % 5 + 1 END AS max_alternatives,
         CASE c_custkey % 7 WHEN 0 THEN 'bus' WHEN 1 THEN 'driving' WHEN 2 THEN 'cycling' WHEN 3 THEN 'walking'
              ELSE 'driving' END AS mode
  FROM customer),
valid AS (SELECT * FROM request WHERE mode <> 'bus' AND max_alternatives <= 5)"""

_METRES = """CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 5e1
                  ELSE o_totalprice / 1e2 + o_totalprice / 1e2 END"""


def _km(metres: str) -> str:
    return f"CAST(ROUND(CAST(({metres}) / 1e3 AS DECIMAL(24, 12)), 3) AS DOUBLE)"


def _vertex_rows(source: str, group: str, line: str, count: int) -> str:
    return f"""SELECT {group} AS g, {line} AS l, j,
         {vertex_lon(group, line, 'j')} AS lon, {vertex_lat(group, line, 'j')} AS lat
  FROM {source}, (SELECT CAST(unnest(range({count})) AS BIGINT) AS j)"""


ROUTE = f"""route AS (SELECT o_custkey AS request_id, o_orderkey AS idx, {_km(_METRES)} AS length_km FROM orders),
vertex AS ({_vertex_rows('orders', 'o_custkey', 'o_orderkey', 6)}),
seg AS (
  SELECT a.g AS request_id, a.l AS idx, a.j AS part, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2
  FROM vertex a JOIN vertex b ON a.l = b.l AND b.j = a.j + 1)"""

BIKEWAY_SEG = f"""seg AS (
  SELECT a.g AS request_id, a.g AS idx, a.l * 10 + a.j AS part, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2
  FROM (SELECT * FROM ({_vertex_rows('supplier', 's_suppkey', 's_suppkey', 3)})
        UNION ALL SELECT g, l, j, lon, lat FROM ({_vertex_rows('supplier', 's_suppkey', '(1000 + s_suppkey)', 3)})) a
  JOIN (SELECT * FROM ({_vertex_rows('supplier', 's_suppkey', 's_suppkey', 3)})
        UNION ALL SELECT g, l, j, lon, lat FROM ({_vertex_rows('supplier', 's_suppkey', '(1000 + s_suppkey)', 3)})) b
  ON a.g = b.g AND a.l = b.l AND b.j = a.j + 1),
route AS (SELECT s_suppkey AS request_id, s_suppkey AS idx FROM supplier)"""


def _planar_pairs(radius: str, extra: str = "") -> str:
    """CTEs ending in ``pairs``: distinct (request_id, idx, crash_id) within the radius in Mercator units."""
    return f"""seg_m AS (
  SELECT seg.request_id, idx, {_mx('lon1')} AS x1, {_my('lat1')} AS y1, {_mx('lon2')} AS x2, {_my('lat2')} AS y2,
         {radius} AS r FROM seg {extra}),
seg_bin AS (
  SELECT *, unnest(range(CAST(floor((least(x1, x2) - r) / 4e2) AS BIGINT), CAST(floor((greatest(x1, x2) + r) / 4e2) AS BIGINT) + 1)) AS bx
  FROM seg_m),
seg_bins AS (
  SELECT *, unnest(range(CAST(floor((least(y1, y2) - r) / 4e2) AS BIGINT), CAST(floor((greatest(y1, y2) + r) / 4e2) AS BIGINT) + 1)) AS by_
  FROM seg_bin),
near AS (
  SELECT s.request_id, s.idx, c.crash_id, c.mx - s.x1 AS px, c.my - s.y1 AS py, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy, s.r
  FROM seg_bins s JOIN crash_m c
  ON s.bx = CAST(floor(c.mx / 4e2) AS BIGINT) AND s.by_ = CAST(floor(c.my / 4e2) AS BIGINT)),
share AS (
  SELECT *, greatest(0e0, least(1e0, CASE WHEN dx * dx + dy * dy > 0 THEN (px * dx + py * dy) / (dx * dx + dy * dy) ELSE 0e0 END)) AS f
  FROM near),
pairs AS (
  SELECT DISTINCT request_id, idx, crash_id FROM share
  WHERE (px - f * dx) * (px - f * dx) + (py - f * dy) * (py - f * dy) <= r * r)"""


_E2 = "6.6943799901413165e-3"


def _north(lat: str) -> str:
    return f"(6.378137e6 * (1e0 - {_E2}) / pow(1e0 - {_E2} * sin(radians({lat})) * sin(radians({lat})), 1.5e0))"


def _east(lat: str) -> str:
    return f"(6.378137e6 / sqrt(1e0 - {_E2} * sin(radians({lat})) * sin(radians({lat}))) * cos(radians({lat})))"


def _step(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    mid = f"(({lat1} + {lat2}) / 2)"
    return (
        f"sqrt(pow(radians({lat2} - {lat1}) * {_north(mid)}, 2) + pow(radians({lon2} - {lon1}) * {_east(mid)}, 2))"
    )


# Segments cut into pieces of at most 1 km along the great circle.
PIECES = f"""measured AS (
  SELECT *, {_step('lon1', 'lat1', 'lon2', 'lat2')} AS metres FROM seg),
cut AS (
  SELECT *, greatest(CAST(ceil(metres / 1e3) AS BIGINT), 1) AS n,
         cos(radians(lat1)) * cos(radians(lon1)) AS ax, cos(radians(lat1)) * sin(radians(lon1)) AS ay, sin(radians(lat1)) AS az,
         cos(radians(lat2)) * cos(radians(lon2)) AS bx, cos(radians(lat2)) * sin(radians(lon2)) AS by_, sin(radians(lat2)) AS bz
  FROM measured),
arc AS (SELECT *, 2 * asin(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2)) / 2) AS w FROM cut),
step_ AS (SELECT *, unnest(range(n + 1)) AS k FROM arc),
xyz AS (
  SELECT *, CASE WHEN w > 0 THEN sin((1 - k / CAST(n AS DOUBLE)) * w) / sin(w) ELSE 1 END AS wa,
            CASE WHEN w > 0 THEN sin(k / CAST(n AS DOUBLE) * w) / sin(w) ELSE 0 END AS wb FROM step_),
stop_ AS (
  SELECT request_id, idx, part, n, k,
    CASE WHEN k = 0 THEN lon1 WHEN k = n THEN lon2 ELSE degrees(atan2(wa * ay + wb * by_, wa * ax + wb * bx)) END AS lon,
    CASE WHEN k = 0 THEN lat1 WHEN k = n THEN lat2 ELSE
      degrees(atan2(wa * az + wb * bz, sqrt(pow(wa * ax + wb * bx, 2) + pow(wa * ay + wb * by_, 2)))) END AS lat
  FROM xyz),
piece AS (
  SELECT a.request_id, a.idx, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2
  FROM stop_ a JOIN stop_ b ON a.request_id = b.request_id AND a.idx = b.idx AND a.part = b.part AND b.k = a.k + 1),
length_ AS (
  SELECT request_id, idx, greatest(sum({_step('lon1', 'lat1', 'lon2', 'lat2')}) / 1e3, 1e-3) AS km FROM piece GROUP BY ALL)"""


def _metric_pairs(name: str, points: str, metres: str) -> str:
    """CTEs ending in ``name``: distinct (request_id, idx, id) within true metres."""
    n = name
    return f"""{n}_bin AS (
  SELECT *, unnest(range(CAST(floor((least(lon1, lon2) - 2e-3) / 4e-3) AS BIGINT), CAST(floor((greatest(lon1, lon2) + 2e-3) / 4e-3) AS BIGINT) + 1)) AS bx
  FROM piece),
{n}_bins AS (
  SELECT *, unnest(range(CAST(floor((least(lat1, lat2) - 2e-3) / 4e-3) AS BIGINT), CAST(floor((greatest(lat1, lat2) + 2e-3) / 4e-3) AS BIGINT) + 1)) AS by_
  FROM {n}_bin),
{n}_pts AS (SELECT *, {_east('lat')} AS kx, {_north('lat')} AS ky FROM {points}),
{n}_near AS (
  SELECT s.request_id, s.idx, p.id,
    radians(s.lon1 - p.lon) * kx AS ax, radians(s.lat1 - p.lat) * ky AS ay,
    radians(s.lon2 - s.lon1) * kx AS dx, radians(s.lat2 - s.lat1) * ky AS dy
  FROM {n}_bins s JOIN {n}_pts p
  ON s.bx = CAST(floor(p.lon / 4e-3) AS BIGINT) AND s.by_ = CAST(floor(p.lat / 4e-3) AS BIGINT)),
{n}_share AS (
  SELECT *, greatest(0e0, least(1e0, CASE WHEN dx * dx + dy * dy > 0 THEN -(ax * dx + ay * dy) / (dx * dx + dy * dy) ELSE 0e0 END)) AS f
  FROM {n}_near),
{n} AS (
  SELECT DISTINCT request_id, idx, id FROM {n}_share
  WHERE pow(ax + f * dx, 2) + pow(ay + f * dy, 2) <= {metres} * {metres})"""


_CATEGORY = """CASE
  WHEN contains(t, 'pothole') THEN 'pothole'
  WHEN contains(t, 'debris') OR contains(t, 'glass') OR contains(t, 'trash') OR contains(t, 'sand') OR contains(t, 'gravel') THEN 'debris'
  WHEN contains(t, 'signal') OR contains(t, 'traffic light') OR contains(t, 'stop light') THEN 'signal'
  WHEN contains(t, 'bike') OR contains(t, 'bicycle') OR contains(t, 'lane block') OR contains(t, 'path blocked') THEN 'bike_blocked'
  WHEN contains(t, 'snow') OR contains(t, 'ice') THEN 'snow_ice'
  ELSE 'other' END"""
_STATUS = f"""CASE {HAZARD_STATUS}
  WHEN 'Open' THEN 'open' WHEN 'Closed - Done' THEN 'closed' WHEN 'In Progress' THEN 'in_progress' WHEN '' THEN 'unknown'
  WHEN 'Re-Opened' THEN 're-opened' WHEN 'Pending Closure' THEN 'pending_closure' ELSE 'new' END"""

HAZARD = f"""hazard AS (
  SELECT CAST(doc_id AS VARCHAR) AS hazard_id, doc_id, {_CATEGORY} AS category, {_STATUS} AS status,
         {_NOW} - to_days(CAST(doc_id % 500 AS INTEGER)) AS opened_at,
         CASE WHEN doc_id % 7 = 1 THEN {_NOW} - to_days(CAST(doc_id % 500 AS INTEGER) - 3) END AS closed_at,
         {point('doc_id')}
  FROM (SELECT *, lower(source || ' ' || lang || ' ' || text) AS t FROM documents)),
active AS (
  SELECT *, hazard_id AS id FROM hazard
  WHERE status IN ('open', 're-opened', 'in_progress', 'pending_closure', 'waiting_on_customer', 'customer_updated')
    AND (closed_at IS NULL OR closed_at >= {_NOW} - INTERVAL 365 DAY) AND opened_at >= {_NOW} - INTERVAL 365 DAY)"""

_SCORED = f"""crashed AS (
  SELECT route.request_id, route.idx, count(pairs.crash_id) AS crashes
  FROM route JOIN valid USING (request_id) LEFT JOIN pairs ON pairs.request_id = route.request_id AND pairs.idx = route.idx
  GROUP BY ALL),
scored AS (
  SELECT route.request_id, valid.mode, route.idx, route.length_km, crashed.crashes
  FROM route JOIN valid USING (request_id) JOIN crashed ON crashed.request_id = route.request_id AND crashed.idx = route.idx),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY crashes, length_km, idx) AS rank,
    first_value(idx) OVER (PARTITION BY request_id ORDER BY crashes, length_km, idx) AS winner,
    first_value(crashes) OVER (PARTITION BY request_id ORDER BY crashes, length_km, idx) AS winner_crashes,
    first_value(length_km) OVER (PARTITION BY request_id ORDER BY crashes, length_km, idx) AS winner_km
  FROM scored)"""

_RANK = "WITH " + ",\n".join(
    [CRASH, REQUEST, ROUTE, _planar_pairs("valid.buffer_m", "JOIN valid USING (request_id)"), _SCORED]
)
_TILES = f"""tiled AS (
  SELECT crash_id, CAST(floor((mx + {_ORIGIN}) / {_TILE12}) AS INTEGER) AS x,
         CAST(floor(({_ORIGIN} - my) / {_TILE12}) AS INTEGER) AS y FROM crash_m),
tile AS (SELECT x, y, count(*) AS crashes FROM tiled GROUP BY x, y)"""


def _lon_edge(x: str) -> str:
    return f"degrees(({x} * {_TILE12} - {_ORIGIN}) / {_R})"


def _lat_edge(y: str) -> str:
    e = f"(({_ORIGIN} - {y} * {_TILE12}) / {_R})"
    return f"degrees(atan((exp({e}) - exp(-{e})) / 2))"


def _weight(age: str) -> str:
    return f"exp(-ln(2e0) * {age} / 2.4e1)"


_AGE = f"(date_diff('microsecond', occurred_at, {_NOW}) / 1e6 / 2.592e6)"
_EXPOSURE = "CASE severity WHEN 4 THEN 1e0 WHEN 3 THEN 6e-1 WHEN 2 THEN 3e-1 ELSE 1e-1 END"


def _risk(weight: str, select: str, key: str, days: int = 365, metres: str = "5e1", segs: str = ROUTE) -> str:
    hazards = HAZARD.replace("365 DAY", f"{days} DAY")
    return f"""WITH {CRASH}, {segs}, {hazards}, {PIECES},
recent AS (SELECT *, crash_id AS id FROM crash WHERE occurred_at >= {_NOW} - INTERVAL {days} DAY),
{_metric_pairs('near_crash', 'recent', metres)},
{_metric_pairs('near_hazard', 'active', metres)},
c AS (SELECT p.request_id, p.idx, count(*) AS crashes, sum({weight}) AS crash_weight
      FROM near_crash p JOIN crash ON crash.crash_id = p.id GROUP BY ALL),
h AS (SELECT request_id, idx, count(*) AS open_hazards FROM near_hazard GROUP BY ALL),
t AS (
  SELECT route.request_id, route.idx, km, coalesce(crashes, 0) AS crashes, CAST(coalesce(crash_weight, 0) AS BIGINT) AS crash_weight,
         coalesce(open_hazards, 0) AS open_hazards
  FROM route JOIN length_ ON length_.request_id = route.request_id AND length_.idx = route.idx
  LEFT JOIN c ON c.request_id = route.request_id AND c.idx = route.idx
  LEFT JOIN h ON h.request_id = route.request_id AND h.idx = route.idx),
p AS (SELECT *, (1e0 - exp(-(crash_weight / km / 1.5e0))) * 6e1 AS crash_points,
             (1e0 - exp(-(open_hazards / km / 3e0))) * 4e1 AS hazard_points FROM t),
s AS (SELECT *, CAST(ceil(least(crash_points + hazard_points, 1e2)) AS INTEGER) AS score FROM p)
SELECT {key}, {select} FROM s"""


_RISK_COLUMNS = """round(km, 4) AS length_km, crashes, crash_weight, open_hazards, score,
  round(crashes / km, 4) AS crash_cnt_per_km, round(crash_weight / km, 4) AS crash_weight_per_km,
  round(open_hazards / km, 4) AS hazard_per_km, round(crash_points, 4) AS crash_points, round(hazard_points, 4) AS hazard_points"""
_ROUTE_KEY = 'request_id, CAST(idx AS INTEGER) AS "index"'
_SCORE_WEIGHT = "CASE severity WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END"

_LOG = """mx_ AS (SELECT coalesce(max(crashes), 1) AS top FROM tile),
hits AS (SELECT route.request_id, route.idx, count(pairs.crash_id) AS crashes
  FROM route LEFT JOIN pairs ON pairs.request_id = route.request_id AND pairs.idx = route.idx GROUP BY ALL)
SELECT {key}, crashes, least(1e2, CAST(round(CAST(1e2 * log10(1e0 + crashes) / log10(1e0 + top) AS DECIMAL(24, 10)), 2) AS DOUBLE)) AS score
FROM hits, mx_"""

# --- raw tables ----------------------------------------------------------------

RAW_CRASH = _duck(f"""raw AS (
  SELECT event_id AS pos, {RAW_ID.format(id='event_id')} AS id, {RAW_LON.format(id='event_id')} AS lon_text,
         {RAW_LAT.format(id='event_id')} AS lat_text, event_type,
         CASE WHEN event_id % 13 = 0 THEN ts - INTERVAL 6 YEAR ELSE ts END AS t
  FROM events),
parsed AS (
  SELECT *, CASE WHEN isnan(TRY_CAST(trim(lon_text) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(lon_text) AS DOUBLE) END AS lon,
    CAST(lat_text AS DOUBLE) AS lat,
    CASE pos % 4 WHEN 2 THEN date_trunc('second', t) WHEN 3 THEN CASE WHEN pos % 100 <> 3 THEN date_trunc('minute', t) END
         ELSE date_trunc('second', t) END AS local,
    CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS severity
  FROM raw),
timed AS (SELECT *, CASE WHEN pos % 4 = 2 THEN local - INTERVAL 2 HOUR ELSE local END AS utc FROM parsed)""")

RAW_HAZARD = _duck(f"""raw AS (
  SELECT doc_id AS pos, {RAW_ID.format(id='doc_id')} AS id, {RAW_LON.format(id='doc_id')} AS lon_text,
         {RAW_LAT.format(id='doc_id')} AS lat_text, {_CATEGORY} AS category, {_STATUS} AS status,
         CASE WHEN doc_id % 17 <> 0 THEN {_NOW} - to_days(CAST(doc_id % 500 AS INTEGER)) END AS opened_at
  FROM (SELECT *, lower(source || ' ' || lang || ' ' || text) AS t FROM documents)),
parsed AS (
  SELECT *, CASE WHEN isnan(TRY_CAST(trim(lon_text) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(lon_text) AS DOUBLE) END AS lon,
    CAST(lat_text AS DOUBLE) AS lat FROM raw)""")


def _conic(x: str, y: str) -> str:
    """State plane to degrees as CTEs from ``xy(id, x, y)`` to ``lonlat(id, lon, lat)``."""
    e = "sqrt(6.6943800229007876e-3)"
    m = "cos(radians({p})) / sqrt(1 - pow({e} * sin(radians({p})), 2))"
    t = "tan(pi() / 4 - radians({p}) / 2) / pow((1 - {e} * sin(radians({p}))) / (1 + {e} * sin(radians({p}))), {e} / 2)"

    def fill(text: str, p: str) -> str:
        return "(" + text.format(p=p, e=e) + ")"

    steps, last = [], "(pi() / 2 - 2 * atan(t))"
    for i in range(5):
        steps.append(
            f"lat{i} AS (SELECT *, {last} AS p{i} FROM {'conic' if i == 0 else f'lat{i - 1}'})"
        )
        last = f"(pi() / 2 - 2 * atan(t * pow((1 - {e} * sin(p{i})) / (1 + {e} * sin(p{i})), {e} / 2)))"
    p1, p2, p0 = "3.975e1", "3.845e1", "3.78333333333333e1"
    return f"""cone AS (
  SELECT (ln({fill(m, p1)}) - ln({fill(m, p2)})) / (ln({fill(t, p1)}) - ln({fill(t, p2)})) AS n),
cone2 AS (SELECT n, {fill(m, p1)} / (n * pow({fill(t, p1)}, n)) AS f FROM cone),
cone3 AS (SELECT n, f, 6.378137e6 * f * pow({fill(t, p0)}, n) AS rho0 FROM cone2),
foot AS (
  SELECT xy.*, n, f, (x - 3e6) * 1.2e3 / 3.937e3 AS e_, rho0 - (y - 1e6) * 1.2e3 / 3.937e3 AS n_ FROM xy, cone3),
conic AS (SELECT *, pow(sqrt(e_ * e_ + n_ * n_) / (6.378137e6 * f), 1 / n) AS t, degrees(atan2(e_, n_) / n) - 1.055e2 AS lon FROM foot),
{', '.join(steps)},
lonlat AS (SELECT id, lon, degrees({last}) AS lat FROM lat4)"""


_BIKE_ROWS = _duck(f"""bike AS (
  SELECT s_suppkey AS pos, {RAW_ID.format(id='s_suppkey')} AS infra_id,
    CASE s_nationkey % 3 WHEN 0 THEN 'protected' WHEN 1 THEN 'trail' ELSE 'shared' END AS class,
    CASE s_nationkey % 2 WHEN 0 THEN 'EXISTING' ELSE '' END AS status,
    CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS parts
  FROM supplier WHERE s_suppkey % 9 NOT IN (4, 5)),
kept AS (SELECT * FROM bike QUALIFY row_number() OVER (PARTITION BY infra_id ORDER BY pos DESC) = 1)""")


def _with_zeros(pairs: str, name: str) -> str:
    """Hits per route, 0 for routes without any."""
    return f"""hits AS (SELECT {_ROUTE_KEY}, count(*) AS n FROM {pairs} GROUP BY ALL)
SELECT o_custkey AS request_id, CAST(o_orderkey AS INTEGER) AS "index", coalesce(n, 0) AS {name}
FROM orders LEFT JOIN hits ON hits.request_id = o_custkey AND hits."index" = o_orderkey"""


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    ix = 'CAST(idx AS INTEGER) AS "index"'

    # ranking
    out["rank_routes"] = f"{_RANK} SELECT request_id, mode, {ix}, length_km, crashes, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_winner FROM ranked"
    out["rank_feature_values"] = f"""{_RANK},
line AS (SELECT g AS request_id, l AS idx, count(*) AS vertices, round(sum(lon), 6) AS lon_sum, round(sum(lat), 6) AS lat_sum FROM vertex GROUP BY g, l)
SELECT request_id, 'FeatureCollection' AS document, CAST(rank - 1 AS INTEGER) AS place, {ix}, crashes, length_km, rank = 1 AS is_winner,
  'LineString' AS shape, CAST(vertices AS INTEGER) AS vertices, lon_sum, lat_sum FROM ranked JOIN line USING (request_id, idx)"""
    out["rank_winners"] = f"""{_RANK}
SELECT valid.request_id, valid.mode, CAST(r.idx AS INTEGER) AS winner, r.crashes, r.length_km, coalesce(n.routes, 0) AS routes
FROM valid LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS routes FROM ranked GROUP BY 1) n USING (request_id)"""
    out["rank_enriched"] = f"""{_RANK},
d AS (SELECT *, crashes - winner_crashes AS cd, round(length_km - winner_km, 3) AS kd,
  CASE WHEN rank = 1 THEN -1 WHEN rank = 2 THEN 0 WHEN rank = 3 THEN 1 ELSE 2 END AS rr FROM ranked)
SELECT request_id, {ix}, CAST(rr AS INTEGER) AS risk_rank,
  CASE rr WHEN -1 THEN 'winner' WHEN 0 THEN 'medium' ELSE 'high' END AS risk_class,
  CASE rr WHEN -1 THEN 'Best Route' WHEN 0 THEN 'Average Risk' ELSE 'Higher Risk' END AS badge,
  cd AS crash_difference, kd AS km_difference,
  CASE WHEN rank > 1 THEN CASE WHEN cd > 0 THEN '+' || cd || ' more crash' || CASE WHEN cd = 1 THEN '' ELSE 'es' END
    ELSE abs(cd) || ' fewer crash' || CASE WHEN abs(cd) = 1 THEN '' ELSE 'es' END END END AS crash_text,
  CASE WHEN rank > 1 THEN CASE
    WHEN kd > 0 THEN '+' || CAST(CAST(round(CAST(kd AS DECIMAL(12, 3)), 1) AS DECIMAL(12, 1)) AS VARCHAR) || ' km longer'
    ELSE CAST(CAST(round(CAST(abs(kd) AS DECIMAL(12, 3)), 1) AS DECIMAL(12, 1)) AS VARCHAR) || ' km shorter' END END AS length_text
FROM d"""
    out["request_summary"] = f"{_RANK} SELECT request_id, count(*) AS routes, min(crashes) AS min_crashes, max(crashes) AS max_crashes FROM scored GROUP BY 1"
    out["route_bbox"] = f"""WITH {REQUEST}, vertex AS ({_vertex_rows('orders', 'o_custkey', 'o_orderkey', 6)}),
v AS (SELECT g, lon, lat FROM vertex UNION ALL
  SELECT o_custkey, {vertex_lon('o_custkey', 'o_custkey', '0')}, {vertex_lat('o_custkey', 'o_custkey', '0')} FROM orders UNION ALL
  SELECT o_custkey, {vertex_lon('o_custkey', 'o_custkey', '5')}, {vertex_lat('o_custkey', 'o_custkey', '5')} FROM orders)
SELECT g AS request_id, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north
FROM v JOIN valid ON g = request_id GROUP BY g"""
    out["request_validation"] = f"""WITH {REQUEST}
SELECT request_id, buffer_m, CAST(max_alternatives AS INTEGER) AS max_alternatives, mode, false AS use_fixture,
  CASE WHEN max_alternatives > 5 THEN 'max_alternatives' WHEN mode = 'bus' THEN 'mode' END AS error FROM request"""
    out["route_length"] = f'SELECT o_custkey AS request_id, CAST(o_orderkey AS INTEGER) AS "index", {_km(_METRES)} AS length_km FROM orders'
    out["route_documents"] = f"""
SELECT o_orderkey AS request_id, 0 AS "index", 6 AS vertices, {_km('o_totalprice / 5e1')} AS length_km FROM orders
UNION ALL SELECT o_orderkey, 1, 3, {_km('o_totalprice / 1e2')} FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT o_orderkey, 2, 4, 0e0 FROM orders"""

    # weights
    out["crash_weights"] = f"""WITH {CRASH}
SELECT crash_id, CAST(severity AS SMALLINT) AS severity, occurred_at, round(lon, 6) AS lon, round(lat, 6) AS lat,
  round({_EXPOSURE}, 6) AS sev_w, round({_AGE}, 6) AS age_months, round({_weight(_AGE)}, 6) AS rec_w,
  round({_EXPOSURE} * {_weight(_AGE)}, 6) AS weight FROM crash"""
    out["severity_weights"] = f"""WITH {CRASH}
SELECT crash_id, {_EXPOSURE} AS exposure_literal,
  CASE severity WHEN 1 THEN 1e0 WHEN 2 THEN 6e-1 WHEN 3 THEN 3e-1 ELSE 1e-1 END AS exposure_corrected,
  CAST({_SCORE_WEIGHT} AS INTEGER) AS score_literal,
  CAST(CASE severity WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS score_corrected FROM crash"""
    out["route_weighted_exposure"] = f"""{_RANK}
SELECT route.request_id, CAST(route.idx AS INTEGER) AS "index", round(coalesce(sum({_EXPOSURE} * {_weight(_AGE)}), 0e0), 6) AS exposure
FROM route JOIN valid USING (request_id) LEFT JOIN pairs ON pairs.request_id = route.request_id AND pairs.idx = route.idx
LEFT JOIN crash ON crash.crash_id = pairs.crash_id GROUP BY 1, 2"""
    out["severity_mix"] = f"""WITH {CRASH}
SELECT CAST(severity AS SMALLINT) AS severity, count(*) AS crashes, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM crash GROUP BY 1"""
    out["route_severity_mix"] = f"""{_RANK}
SELECT pairs.request_id, CAST(pairs.idx AS INTEGER) AS "index", CAST(count(*) FILTER (severity = 1) AS BIGINT) AS fatal,
  CAST(count(*) FILTER (severity = 2) AS BIGINT) AS serious, CAST(count(*) FILTER (severity = 3) AS BIGINT) AS minor
FROM pairs JOIN crash USING (crash_id) GROUP BY 1, 2"""

    # tiles
    tiles = f"WITH {CRASH}, {_TILES}"
    out["tile_coords"] = f"{tiles} SELECT crash_id, x, y FROM tiled"
    out["crash_tiles"] = f"{tiles} SELECT x, y, crashes FROM tile"
    # Some crashes have no place on the map: an infinite or missing longitude, a latitude beyond the pole.
    dirty = f"""{tiles}, kept AS (SELECT x, y, count(*) AS crashes FROM tiled WHERE CAST(crash_id AS BIGINT) % 50 > 4 GROUP BY 1, 2)"""
    out["crash_tiles_dirty"] = f"{dirty} SELECT x, y, crashes FROM kept"
    out["busiest_tile_dirty"] = f"{dirty} SELECT max(crashes) AS max_tile FROM kept"
    out["crash_tiles_z15"] = f"{tiles} SELECT x, y, crashes FROM tile".replace("4.096e3", "3.2768e4")
    out["sql_tile_coords"] = f"{tiles} SELECT crash_id, x, y FROM tiled WHERE CAST(crash_id AS BIGINT) % 50 > 4"
    out["sql_crash_weights"] = f"""WITH {CRASH}, w AS (SELECT crash_id, CASE severity WHEN 4 THEN 1e0 WHEN 3 THEN 6e-1 WHEN 2 THEN 3e-1 ELSE 1e-1 END AS sev_w, {_AGE} AS age FROM crash)
SELECT crash_id, sev_w, round(age, 6) AS age_months, round({_weight('age')}, 6) AS rec_w, round(sev_w * {_weight('age')}, 6) AS weight FROM w"""
    out["sql_tile_scores"] = f"""{tiles}, w AS (SELECT x, y, count(*) AS crashes, sum({_SCORE_WEIGHT}) AS weight FROM tiled JOIN crash USING (crash_id) GROUP BY x, y)
SELECT x, y, crashes, least(1e2, round(1e2 * (log10(1e0 + crashes) / log10(1e0 + (SELECT max(crashes) FROM w))), 2)) AS score,
  CAST(ceil(least((1e0 - exp(-(weight / 1e3 / 1.5e0))) * 6e1 + (1e0 - exp(-(crashes / 1e3 / 3e0))) * 4e1, 1e2)) AS INTEGER) AS risk FROM w"""
    out["busiest_tile"] = f"{tiles} SELECT max(crashes) AS max_tile FROM tile"
    out["top_tiles"] = f"{tiles} SELECT x, y, crashes FROM tile ORDER BY crashes DESC, x, y LIMIT 20"
    out["tile_polygon"] = f"""{tiles} SELECT x, y, round({_lon_edge('x')}, 6) AS west, round({_lat_edge('(y + 1)')}, 6) AS south,
  round({_lon_edge('(x + 1)')}, 6) AS east, round({_lat_edge('y')}, 6) AS north FROM tile"""
    out["tile_lookup"] = f"{tiles} SELECT x, y, crashes FROM tile WHERE x = 853 AND y = 1554"
    out["tile_features"] = f"""{tiles} SELECT x, y, 5 AS corners, round({_lon_edge('x')}, 6) AS west, round({_lat_edge('(y + 1)')}, 6) AS south,
  round({_lon_edge('(x + 1)')}, 6) AS east, round({_lat_edge('y')}, 6) AS north FROM tile"""

    box = f"""WITH {CRASH}, {REQUEST}, {ROUTE}, {_TILES},
box AS (SELECT x, y, crashes, x * {_TILE12} - {_ORIGIN} AS west, (x + 1) * {_TILE12} - {_ORIGIN} AS east,
  {_ORIGIN} - (y + 1) * {_TILE12} AS south, {_ORIGIN} - y * {_TILE12} AS north FROM tile),
s AS (SELECT seg.request_id, idx, {_mx('lon1')} AS x1, {_my('lat1')} AS y1, {_mx('lon2')} AS x2, {_my('lat2')} AS y2, valid.buffer_m AS r
  FROM seg JOIN valid USING (request_id)),
n AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s JOIN box
  ON greatest(x1, x2) + r >= west AND least(x1, x2) - r <= east AND greatest(y1, y2) + r >= south AND least(y1, y2) - r <= north),
-- Inside the box at an end, or across one of its sides.
c AS (SELECT *, (x1 BETWEEN west AND east AND y1 BETWEEN south AND north) OR (x2 BETWEEN west AND east AND y2 BETWEEN south AND north)
  OR (dx <> 0 AND (west - x1) / dx BETWEEN 0 AND 1 AND y1 + dy * (west - x1) / dx BETWEEN south AND north)
  OR (dx <> 0 AND (east - x1) / dx BETWEEN 0 AND 1 AND y1 + dy * (east - x1) / dx BETWEEN south AND north)
  OR (dy <> 0 AND (south - y1) / dy BETWEEN 0 AND 1 AND x1 + dx * (south - y1) / dy BETWEEN west AND east)
  OR (dy <> 0 AND (north - y1) / dy BETWEEN 0 AND 1 AND x1 + dx * (north - y1) / dy BETWEEN west AND east) AS inside FROM n),
gap AS (SELECT *, least({', '.join(f"""pow({cx} - x1 - greatest(0e0, least(1e0, (({cx} - x1) * dx + ({cy} - y1) * dy) / (dx * dx + dy * dy))) * dx, 2)
  + pow({cy} - y1 - greatest(0e0, least(1e0, (({cx} - x1) * dx + ({cy} - y1) * dy) / (dx * dx + dy * dy))) * dy, 2)""" for cx in ('west', 'east') for cy in ('south', 'north'))},
  pow(greatest(west - x1, 0e0, x1 - east), 2) + pow(greatest(south - y1, 0e0, y1 - north), 2),
  pow(greatest(west - x2, 0e0, x2 - east), 2) + pow(greatest(south - y2, 0e0, y2 - north), 2)) AS g FROM c),
touched AS (SELECT DISTINCT request_id, idx, x, y, crashes FROM gap WHERE inside OR g <= r * r)"""
    out["tiles_on_route"] = f"{box} SELECT request_id, {ix}, count(*) AS tiles, CAST(sum(crashes) AS BIGINT) AS crashes FROM touched GROUP BY ALL"

    def ring() -> str:
        w, s_, e, n = (f"CAST(round({c}, 6) AS VARCHAR)" for c in (_lon_edge("x"), _lat_edge("(y + 1)"), _lon_edge("(x + 1)"), _lat_edge("y")))
        corners = " || ',' || ".join(f"'[' || {a} || ',' || {b} || ']'" for a, b in ((w, s_), (w, n), (e, n), (e, s_), (w, s_)))
        return (
            f"""'{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || {corners} || ']]}},"properties":{{"x":' || x"""
            """ || ',"y":' || y || ',"crashes":' || crashes || '}}'"""
        )

    collection = """SELECT '{"type":"FeatureCollection","features":' || coalesce('[' || string_agg(f, ',' ORDER BY crashes DESC, x, y) || ']', 'null') || '}' AS document"""
    out["tile_feature_collection"] = f"{tiles} {collection} FROM (SELECT *, {ring()} AS f FROM tile WHERE x = 853 AND y = 1554)"
    out["top_tiles_feature_collection"] = f"{tiles} {collection} FROM (SELECT *, {ring()} AS f FROM tile ORDER BY crashes DESC, x, y LIMIT 20)"

    out["tile_document_parts"] = f"""{tiles}, placed AS (SELECT *, row_number() OVER (ORDER BY crashes DESC, x, y) - 1 AS k, {ring()} AS f FROM tile),
part AS (SELECT k // 10 AS part, string_agg(f, ',' ORDER BY k) AS t FROM placed GROUP BY 1)
SELECT part, CASE WHEN part = 0 THEN '{{"type":"FeatureCollection","features":[' ELSE ',' END || t AS text FROM part
UNION ALL SELECT max(part) + 1, ']}}' FROM part HAVING count(*) > 0"""

    # scores
    out["score_routes"] = _risk(_SCORE_WEIGHT, _RISK_COLUMNS, _ROUTE_KEY)
    out["score_routes_corrected"] = _risk(
        "CASE severity WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END", "crash_weight, score", _ROUTE_KEY
    )
    out["score_wkt"] = _risk(_SCORE_WEIGHT, "crashes, open_hazards, score", _ROUTE_KEY, 20, "8e1")
    bike_key = "CAST(idx AS VARCHAR) AS infra_id"
    out["score_bikeways"] = _risk(_SCORE_WEIGHT, _RISK_COLUMNS, bike_key, segs=BIKEWAY_SEG)
    out["score_one_bikeway"] = _risk(_SCORE_WEIGHT, "crashes, open_hazards, score", bike_key, segs=BIKEWAY_SEG) + " WHERE idx = 7"
    out["recent_crashes_near_route"] = f"""WITH {CRASH}, {ROUTE}, {PIECES},
recent AS (SELECT *, crash_id AS id FROM crash WHERE occurred_at >= {_NOW} - INTERVAL 14 DAY),
{_metric_pairs('near_crash', 'recent', '5e1')},
{_with_zeros('near_crash', 'crashes')}"""
    out["open_hazards_near_route"] = f"""WITH {HAZARD}, {ROUTE}, {PIECES}, {_metric_pairs('near_hazard', 'active', '5e1')},
{_with_zeros('near_hazard', 'open_hazards')}"""
    out["active_hazards"] = f"WITH {HAZARD} SELECT hazard_id, status, opened_at, closed_at FROM active"
    out["log_score_routes"] = f"WITH {CRASH}, {ROUTE}, {_TILES}, {_planar_pairs('6e1')}, {_LOG.format(key=_ROUTE_KEY)}"
    out["log_score_bikeways"] = f"WITH {CRASH}, {BIKEWAY_SEG}, {_TILES}, {_planar_pairs('6e1')}, {_LOG.format(key=bike_key)}"

    out["log_score_one_bikeway"] = f"SELECT * FROM ({out['log_score_bikeways']}) WHERE infra_id = '7'"

    out["risk_payload_values"] = f"SELECT *, 365 AS lookback_days, CAST(50 AS DOUBLE) AS buffer_m FROM ({out['score_bikeways']})"

    # loading
    out["load_crash"] = f"""WITH {RAW_CRASH},
ok AS (SELECT * FROM timed WHERE lon IS NOT NULL AND utc >= {_NOW} - INTERVAL 5 YEAR)
SELECT id AS crash_id, utc AS occurred_at, CAST(severity AS SMALLINT) AS severity, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1"""
    out["load_hazard"] = f"""WITH {RAW_HAZARD},
ok AS (SELECT * FROM parsed WHERE lon IS NOT NULL AND opened_at >= {_NOW} - INTERVAL 365 DAY)
SELECT id AS hazard_id, category, status, opened_at, CAST(NULL AS TIMESTAMP) AS closed_at, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1"""
    corners = " UNION ALL ".join(
        f"SELECT pos AS id, 3140000e0 + (pos * 7919) % 10007 + {dx} AS x, 1690000e0 + (pos * 6101) % 10009 + {dy} AS y FROM kept{where}"
        for dx, dy, where in (
            (0, 0, ""), (500, 250, ""), (900, 700, ""), (1500, 0, " WHERE parts = 2"), (1900, 300, " WHERE parts = 2"),
        )
    )
    out["load_bikeway"] = f"""WITH {_BIKE_ROWS}, xy AS ({corners}), {_conic('x', 'y')}
SELECT infra_id, class, '' AS on_off, status, parts, CAST(count(*) AS INTEGER) AS vertices, round(min(lon), 6) AS west, round(min(lat), 6) AS south,
  round(max(lon), 6) AS east, round(max(lat), 6) AS north
FROM kept JOIN lonlat ON lonlat.id = kept.pos GROUP BY infra_id, class, status, parts"""
    out["hazard_categories"] = f"WITH {HAZARD} SELECT hazard_id, category FROM hazard"
    out["hazard_statuses"] = f"WITH {HAZARD} SELECT hazard_id, status FROM hazard"
    out["crash_severity"] = f"WITH {RAW_CRASH} SELECT pos AS row, CAST(severity AS SMALLINT) AS severity FROM parsed"
    out["lenient_numbers"] = f"""WITH {RAW_CRASH} SELECT pos AS row, round(lon, 6) AS lon,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS fatalities,
  CAST(CASE WHEN event_type = 'purchase' THEN 2 WHEN pos % 5 = 0 THEN 0 ELSE -1 END AS BIGINT) AS injured,
  CAST(1000 + pos % 1000 AS DOUBLE) AS length FROM parsed"""
    out["lenient_times"] = f"WITH {RAW_CRASH} SELECT pos AS row, utc, local FROM timed"
    for name, order in (("dedupe_first", "pos"), ("dedupe_last", "pos DESC")):
        out[name] = f"""WITH {RAW_CRASH} SELECT id AS incident_id, pos AS row, lat_text AS geo_lat FROM raw
QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order}) = 1"""
    out["merge_crash"] = f"""WITH {CRASH} SELECT crash_id, occurred_at,
  CAST(CASE WHEN occurred_at >= TIMESTAMP '2024-01-10 00:00:00' THEN 4 - severity ELSE severity END AS SMALLINT) AS severity,
  round(lon, 6) AS lon, round(lat, 6) AS lat FROM crash"""
    out["merge_hazard"] = f"""WITH {HAZARD},
f AS (SELECT *, opened_at < TIMESTAMP '2023-08-01 00:00:00' AS o, opened_at >= TIMESTAMP '2023-05-01 00:00:00' AS n FROM hazard)
SELECT hazard_id, category, CASE WHEN n THEN 'closed' ELSE status END AS status,
  CASE WHEN o THEN opened_at WHEN category <> 'other' THEN opened_at END AS opened_at,
  CASE WHEN n AND category = 'other' THEN {_NOW} WHEN o THEN closed_at END AS closed_at FROM f"""
    out["merge_bikeway"] = f"""WITH {_BIKE_ROWS},
stored AS (SELECT CAST(s_suppkey AS VARCHAR) AS infra_id,
  CASE s_nationkey % 6 WHEN 0 THEN 'protected' WHEN 1 THEN 'buffered' WHEN 2 THEN 'painted' WHEN 3 THEN 'shared' WHEN 4 THEN 'trail' ELSE 'unpaved' END AS class,
  CASE s_nationkey % 3 WHEN 0 THEN 'EXISTING' WHEN 1 THEN 'PROPOSED' ELSE 'UNKNOWN' END AS status FROM supplier)
SELECT infra_id, coalesce(k.class, s.class) AS class, '' AS on_off, coalesce(k.status, s.status) AS status, coalesce(k.parts, 2) AS parts
FROM stored s FULL JOIN kept k USING (infra_id)"""
    moved = f"""WITH {CRASH}, {RAW_CRASH},
ok AS (SELECT * FROM timed WHERE lon IS NOT NULL AND utc >= {_NOW} - INTERVAL 5 YEAR),
fresh AS (SELECT id AS crash_id, utc, severity, lon, lat FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
old AS (SELECT crash_id, occurred_at, severity, lon, lat FROM crash WHERE occurred_at < TIMESTAMP '2024-01-20 00:00:00'),
merged AS (
  SELECT crash_id, coalesce(f.utc, old.occurred_at) AS occurred_at, CAST(coalesce(f.severity, old.severity) AS SMALLINT) AS severity,
    coalesce(f.lon, old.lon) AS lon, coalesce(f.lat, old.lat) AS lat FROM old FULL JOIN fresh f USING (crash_id))"""
    out["load_and_merge_crash"] = f"{moved} SELECT crash_id, occurred_at, severity, round(lon, 6) AS lon, round(lat, 6) AS lat FROM merged"

    def tiled(source: str) -> str:
        return f"""(SELECT CAST(floor(({_mx('lon')} + {_ORIGIN}) / {_TILE12}) AS INTEGER) AS x,
  CAST(floor(({_ORIGIN} - {_my('lat')}) / {_TILE12}) AS INTEGER) AS y, count(*) AS crashes FROM {source} GROUP BY ALL)"""

    out["tiles_after_merge"] = f"{moved} SELECT x, y, crashes FROM {tiled('merged')}"
    out["busiest_tile_after_merge"] = f"{moved} SELECT max(crashes) AS max_tile FROM {tiled('merged')}"
    out["tile_changes"] = f"""{moved} SELECT * FROM (
  SELECT x, y, coalesce(a.crashes, 0) - coalesce(b.crashes, 0) AS change
  FROM {tiled('merged')} a FULL JOIN {tiled('old')} b USING (x, y)) WHERE change <> 0"""
    out["load_and_merge_hazard"] = f"""WITH {HAZARD}, {RAW_HAZARD},
ok AS (SELECT * FROM parsed WHERE lon IS NOT NULL AND opened_at >= {_NOW} - INTERVAL 365 DAY),
fresh AS (SELECT id AS hazard_id, category, status, opened_at, lon, lat FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
old AS (SELECT * FROM hazard WHERE opened_at < TIMESTAMP '2023-08-01 00:00:00')
SELECT hazard_id, coalesce(f.category, old.category) AS category, coalesce(f.status, old.status) AS status,
  coalesce(f.opened_at, old.opened_at) AS opened_at, old.closed_at, round(coalesce(f.lon, old.lon), 6) AS lon, round(coalesce(f.lat, old.lat), 6) AS lat
FROM old FULL JOIN fresh f USING (hazard_id)"""
    both = " UNION ALL ".join(f"SELECT g, lon, lat FROM ({_vertex_rows('supplier', 's_suppkey', line, 3)})" for line in ("s_suppkey", "(1000 + s_suppkey)"))
    out["load_and_merge_bikeway"] = f"""SELECT infra_id, coalesce(f.class, m.class) AS class, m.on_off, coalesce(f.status, m.status) AS status, m.parts,
  CAST(coalesce(f.vertices, b.vertices) AS INTEGER) AS vertices, coalesce(f.west, b.west) AS west, coalesce(f.south, b.south) AS south
FROM ({out['merge_bikeway']}) m LEFT JOIN ({out['load_bikeway']}) f USING (infra_id)
LEFT JOIN (SELECT CAST(g AS VARCHAR) AS infra_id, count(*) AS vertices, round(min(lon), 6) AS west, round(min(lat), 6) AS south FROM ({both}) GROUP BY g) b
  USING (infra_id)"""
    out["incremental_load"] = f"""WITH {CRASH} SELECT crash_id, occurred_at, CAST(severity + CASE WHEN day(occurred_at) >= 20 THEN 2
  WHEN day(occurred_at) >= 10 THEN 1 ELSE 0 END AS SMALLINT) AS severity FROM crash"""
    watch = ROUTE.replace("orders", "customer").replace("o_custkey", "c_custkey").replace("o_orderkey", "c_custkey")
    watch = watch[watch.index("vertex AS"):]
    out["hazard_alert"] = f"""WITH {HAZARD}, {watch}, {PIECES},
opened AS (SELECT *, hazard_id AS id FROM hazard WHERE status IN ('open', 're-opened', 'in_progress', 'pending_closure')),
{_metric_pairs('near_hazard', 'opened', '5e1')}
SELECT CAST(n.idx AS VARCHAR) AS user_id, 'home' AS route_id, n.id AS hazard_id, h.category, h.opened_at
FROM near_hazard n JOIN hazard h ON h.hazard_id = n.id"""
    week = "TIMESTAMP '1970-01-01' + to_days(CAST(7 * floor(epoch(opened_at) / 604800) AS INTEGER))"
    out["hazard_digest"] = f"""SELECT user_id, route_id, category, {week} AS window_start, {week} + INTERVAL 7 DAY AS window_end,
  count(*) AS hazards, min(opened_at) AS first_at, max(opened_at) AS last_at FROM ({out['hazard_alert']}) WHERE opened_at IS NOT NULL GROUP BY ALL"""
    out["key_violation"] = f"""WITH {RAW_CRASH},
g AS (SELECT id, count(*) AS n, count(*) FILTER (lon IS NULL) AS m FROM parsed GROUP BY id)
SELECT id AS incident_id, 'repeated key' AS problem, n AS rows FROM g WHERE n > 1
UNION ALL SELECT id, 'missing value', m FROM g WHERE m > 0"""
    out["load_report"] = """SELECT 'crash' AS "table", count(*) AS "rows" FROM events UNION ALL
SELECT 'hazard', count(*) FROM documents UNION ALL SELECT 'bikeway', count(*) FROM supplier"""

    # geometry
    out["wkt_roundtrip"] = f"""SELECT o_custkey AS request_id, CAST(o_orderkey AS INTEGER) AS "index", true AS strict_same,
  true AS parts_same, 0 AS strict_lower, 6 AS pairs FROM orders"""
    out["mercator_roundtrip"] = f"""WITH {CRASH} SELECT crash_id, round(mx, 4) AS mx, round(my, 4) AS my, round(lon, 6) AS lon, round(lat, 6) AS lat FROM crash_m"""
    out["state_plane_to_wgs84"] = f"""WITH xy AS (SELECT event_id AS id, 3140000e0 + (event_id * 7919) % 10007 AS x, 1690000e0 + (event_id * 6101) % 10009 AS y FROM events),
{_conic('x', 'y')}
SELECT id AS event_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM lonlat"""
    out["geodesic_length"] = f"""WITH {ROUTE}, {PIECES}
SELECT m.request_id, CAST(m.idx AS INTEGER) AS "index", round(m.total, 3) AS metres, round(km * 1e3, 3) AS metres_cut
FROM (SELECT request_id, idx, sum(metres) AS total FROM measured GROUP BY ALL) m
JOIN length_ ON length_.request_id = m.request_id AND length_.idx = m.idx"""
    out["line_clean"] = """SELECT o_custkey AS request_id, CAST(o_orderkey AS INTEGER) AS "index", 1 AS parts, 6 AS vertices, true AS same FROM orders"""

    # alternatives
    start = (vertex_lon("request_id", "request_id", "0"), vertex_lat("request_id", "request_id", "0"))
    end = (vertex_lon("request_id", "request_id", "5"), vertex_lat("request_id", "request_id", "5"))
    out["detour_waypoints"] = f"""WITH {REQUEST},
e AS (SELECT *, {start[0]} AS slon, {start[1]} AS slat, {end[0]} AS elon, {end[1]} AS elat FROM valid),
m AS (SELECT *, (slon + elon) / 2 AS lon, (slat + elat) / 2 AS lat FROM e),
first_ AS (SELECT o_custkey AS request_id, min(o_orderkey) AS o FROM orders GROUP BY 1),
c AS (SELECT unnest([0, 1, 2, 3]) AS step, unnest([0e0, 0e0, 2e-2, -2e-2]) AS dx, unnest([2e-2, -2e-2, 0e0, 0e0]) AS dy),
l AS (SELECT unnest([0, 1]) AS step, unnest([2, 4]) AS j, unnest([1, -1]) AS sign),
k AS (SELECT unnest([0, 1, 2, 3, 4]) AS step)
SELECT request_id, 'compass' AS kind, step, round(lon + dx, 6) AS lon, round(lat + dy, 6) AS lat FROM m, c
UNION ALL SELECT request_id, 'on_line', step,
  round({vertex_lon('request_id', 'o', 'j')} + sign * (elat - slat) * 5e-3, 6),
  round({vertex_lat('request_id', 'o', 'j')} - sign * (elon - slon) * 5e-3, 6) FROM m JOIN first_ USING (request_id), l
UNION ALL SELECT request_id, 'east_west', step, round(lon + CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END * 1e-2 * (step + 1), 6), round(lat, 6)
FROM m, k WHERE step < max_alternatives"""
    accepted = f"""WITH {REQUEST},
prim AS (SELECT o_custkey AS request_id, min(o_orderkey) AS idx,
  coalesce(arg_min(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 5e1 ELSE 0e0 END, o_orderkey), 0) AS p
  FROM orders JOIN valid ON valid.request_id = o_custkey GROUP BY 1),
cand AS (SELECT o_custkey AS request_id, o_orderkey AS idx, o_totalprice / 2e2 * 4.4e0 AS d,
  CASE o_orderkey % 3 WHEN 0 THEN 'east_west' WHEN 1 THEN 'compass' ELSE 'on_line' END AS kind FROM orders WHERE o_orderkey % 7 <> 0),
accepted AS (SELECT request_id, cand.idx, kind FROM cand JOIN prim USING (request_id)
  WHERE kind = 'east_west' OR abs(d - p) / greatest(p, 1e0) > CASE kind WHEN 'compass' THEN 3e-2 ELSE 5e-2 END)"""
    was = "CAST(idx AS INTEGER) AS was"
    out["distinct_alternatives"] = f"{accepted} SELECT request_id, {was}, kind FROM accepted"
    out["more_routes"] = f"""{accepted},
both_ AS (SELECT 0 AS f, request_id, idx FROM prim UNION ALL
  SELECT CASE kind WHEN 'compass' THEN 1 WHEN 'on_line' THEN 2 ELSE 3 END, request_id, idx FROM accepted),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY f, idx) AS n FROM both_)
SELECT request_id, {was}, CAST(n - 1 AS INTEGER) AS "index" FROM numbered JOIN valid USING (request_id) WHERE f = 0 OR n <= max_alternatives"""
    lat = " + ".join(f"({vertex_lat('request_id', 'o', str(j))})" for j in range(6))
    turns = " + ".join(f"({vertex_lat('request_id', 'o', str(j))}) * {1 if j % 2 == 0 else -1}" for j in range(6))
    for name, first, more, shift, by_turns in (
        ("pad_alternatives", "1.05e0", "5e-2", "0e0", "6 * 1e-3 * (copy + 1)"),
        ("pad_alternatives_shifted", "1.1e0", "1e-1", "CASE WHEN copy % 2 = 0 THEN 6 ELSE -6 END * 2e-3 * (copy + 1)", "0e0"),
    ):
        out[name] = f"""WITH {REQUEST},
have AS (SELECT o_custkey AS request_id, count(*) AS n, max(o_orderkey) AS last_, min(o_orderkey) AS o FROM orders GROUP BY 1),
short AS (SELECT *, unnest(range(max_alternatives - n)) AS copy FROM have JOIN valid USING (request_id) WHERE n < max_alternatives),
base AS (SELECT short.*, CASE WHEN o % 3 <> 0 THEN o_totalprice / 5e1 END AS d, o_totalprice / 2e2 AS t FROM short JOIN orders ON o_orderkey = o)
SELECT o_custkey AS request_id, CAST(o_orderkey AS INTEGER) AS "index", false AS is_synthetic,
  round(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 5e1 END, 8) AS distance, round(o_totalprice / 2e2, 8) AS duration,
  round({lat.replace('request_id', 'o_custkey').replace('(o *', '(o_orderkey *')}, 6) AS lat_sum,
  round({turns.replace('request_id', 'o_custkey').replace('(o *', '(o_orderkey *')}, 6) AS lat_by_turns FROM orders
UNION ALL SELECT request_id, CAST(last_ + 1 + copy AS INTEGER), true, round(d * ({first} + copy * {more}), 8), round(t * ({first} + copy * {more}), 8),
  round({lat} + {shift}, 6), round({turns} + {by_turns}, 6) FROM base"""
    return out
