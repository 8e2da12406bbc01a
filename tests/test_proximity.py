"""The cell join against brute force, on every path it can take."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import proximity as P
from kerbline.operators.tiles import crash_tiles, tiles_on_lines

R = 6378137.0
E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)


def _mercator(lon, lat):
    return math.radians(lon) * R, R * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def _distance(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    f = 0.0 if squared == 0 else min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / squared))
    return math.hypot(px - ax - f * dx, py - ay - f * dy)


def _near(metric, point, line, radius):
    lon, lat = point
    for (alon, alat), (blon, blat) in zip(line, line[1:]):
        if metric == "mercator":
            d = _distance(*_mercator(lon, lat), *_mercator(alon, alat), *_mercator(blon, blat))
        else:
            s = math.sin(math.radians(lat))
            ky = math.radians(1) * R * (1 - E2) / (1 - E2 * s * s) ** 1.5
            kx = math.radians(1) * R / math.sqrt(1 - E2 * s * s) * math.cos(math.radians(lat))
            d = _distance(0, 0, (alon - lon) * kx, (alat - lat) * ky, (blon - lon) * kx, (blat - lat) * ky)
        if d <= radius:
            return True
    return False


def _world(seed, lines=25, points=600, copies=0, step=0.004):
    rng = random.Random(seed)
    spots = [(-105 + rng.random() * 0.03, 39.7 + rng.random() * 0.02) for _ in range(points)]
    spots += [spots[0]] * copies
    shapes = []
    for _ in range(lines):
        x, y = -105 + rng.random() * 0.03, 39.7 + rng.random() * 0.02
        shape = [(x, y)]
        for _ in range(rng.randint(1, 12)):
            x, y = x + (rng.random() - 0.5) * step, y + (rng.random() - 0.5) * step
            shape.append((x, y))
        if rng.random() < 0.3:
            shape.append(shape[0])
        if rng.random() < 0.3:
            shape.insert(1, shape[0])
        shapes.append(shape)
    radii = [rng.choice([15.0, 60.0, 200.0]) for _ in shapes]
    return spots, shapes, radii


def _frames(spark, spots, shapes, radii):
    points = spark.createDataFrame([(i, x, y, 1, i % 7) for i, (x, y) in enumerate(spots)], "id int, lon double, lat double, n bigint, w bigint")
    lines = spark.createDataFrame(
        [(i, [[{"lon": x, "lat": y} for x, y in s]], r) for i, (s, r) in enumerate(zip(shapes, radii))],
        "k int, parts array<array<struct<lon:double,lat:double>>>, radius double",
    )
    return points, lines


def _brute(metric, spots, shapes, radii):
    out = {}
    for k, (shape, r) in enumerate(zip(shapes, radii)):
        hits = [i for i, p in enumerate(spots) if _near(metric, p, shape, r)]
        if hits:
            out[k] = (len(hits), sum(i % 7 for i in hits))
    return out


PLANS = {
    "broadcast": {"spark.sql.autoBroadcastJoinThreshold": "10m"},
    "shuffled": {"spark.sql.autoBroadcastJoinThreshold": "-1"},
    "skewed": {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    },
}


@pytest.fixture
def plan(spark, request):
    before = {k: spark.conf.get(k, None) for k in PLANS[request.param]}
    for k, v in PLANS[request.param].items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("metric", ["mercator", "geodesic"])
@pytest.mark.parametrize("plan", PLANS, indirect=True)
@pytest.mark.parametrize("zoom", [17, 19])
def test_totals_equal_brute_force(spark, metric, plan, zoom):
    world = _world(zoom + len(metric) + len(plan), copies=200)
    points, lines = _frames(spark, *world)
    got = P.totals_near_lines(
        lines, points, key=["k"], radius="radius", metric=metric, measures=["n", "w"], zoom=zoom
    )
    assert {r.k: (r.n, r.w) for r in got.collect()} == _brute(metric, *world)


def test_wide_radii_list_few_cells(spark):
    spots, shapes, _ = _world(9)
    radii = [[60.0, 5_000.0, 20_000.0][i % 3] for i in range(len(shapes))]
    points, lines = _frames(spark, spots, shapes, radii)
    got = P.totals_near_lines(lines, points, key=["k"], radius="radius", metric="mercator", measures=["n", "w"])
    assert {r.k: (r.n, r.w) for r in got.collect()} == _brute("mercator", spots, shapes, radii)
    stated = P.totals_near_lines(
        lines, points, key=["k"], radius="radius", metric="mercator", measures=["n", "w"], radii=[60.0, 5_000.0, 20_000.0]
    )
    assert sorted(map(tuple, stated.collect())) == sorted(map(tuple, got.collect()))
    zoomed = lines.withColumn("z", P._zoom_column(F.col("radius"), 18))
    cells = P.line_cells(zoomed, ["k"], "parts", "radius", "mercator", "z").groupBy("k", "seg").count()
    assert cells.agg(F.max("count")).first()[0] < 150


def test_long_segments_list_few_cells(spark):
    lines = spark.createDataFrame(
        [(1, [[{"lon": -105.0, "lat": 39.0}, {"lon": -104.0, "lat": 40.0}]], 60.0)],
        "k int, parts array<array<struct<lon:double,lat:double>>>, radius double",
    )
    n = P.line_cells(lines, ["k"], "parts", "radius", "mercator", 18).count()
    across = 111319.5 / P.tile_size(18)
    assert across < n < 8 * across  # linear in the length, not its square


def test_unusable_shapes_have_no_hits(spark):
    inf = float("inf")
    rows = [
        (1, [[]], 60.0), (2, [[{"lon": -105.0, "lat": 39.7}]], 60.0),
        (3, [[{"lon": inf, "lat": 39.7}, {"lon": -105.0, "lat": 39.7}]], 60.0),
        (4, [[{"lon": -105.0, "lat": 39.7}, {"lon": -105.0, "lat": 39.7}]], 60.0),
        (5, [[{"lon": -105.0, "lat": 39.7}, {"lon": -105.1, "lat": 39.7}]], 0.0),
    ]
    lines = spark.createDataFrame(rows, "k int, parts array<array<struct<lon:double,lat:double>>>, radius double")
    points = spark.createDataFrame([(-105.0, 39.7, 1), (float("nan"), 39.7, 1), (inf, 90.0, 1)], "lon double, lat double, n bigint")
    totals = P.totals_near_lines(lines, points, key=["k"], radius="radius", metric="mercator", measures=["n"])
    # Only the repeated vertex is a (zero-length) segment; a buffer of width zero is empty.
    assert [(r.k, r.n) for r in totals.collect()] == [(4, 1)]


def test_long_geodesic_segment_follows_the_great_circle(spark):
    # Halfway along 2 degrees of longitude the great circle runs north of the parallel.
    line = [[{"lon": -105.0, "lat": 45.0}, {"lon": -103.0, "lat": 45.0}]]
    lines = spark.createDataFrame([(1, line, 100.0)], "k int, parts array<array<struct<lon:double,lat:double>>>, radius double")
    rise = math.degrees(math.atan(math.tan(math.radians(45)) / math.cos(math.radians(1)))) - 45
    points = spark.createDataFrame([(-104.0, 45.0, 1), (-104.0, 45.0 + rise, 10)], "lon double, lat double, n bigint")
    totals = P.totals_near_lines(lines, points, key=["k"], radius="radius", metric="geodesic", measures=["n"])
    assert totals.first().n == 10


def test_unknown_metric(spark):
    _, lines = _frames(spark, *_world(1, lines=1, points=1))
    with pytest.raises(ValueError):
        P.line_cells(lines, ["k"], "parts", "radius", "feet")


@pytest.mark.parametrize("plan", PLANS, indirect=True)
def test_tiles_on_lines(spark, plan):
    spots, shapes, radii = _world(5, step=0.02)
    points, lines = _frames(spark, spots, shapes, radii)
    tiles = crash_tiles(points, zoom=15)
    got = {r.k: (r.tiles, r.crashes) for r in tiles_on_lines(lines, tiles, key=["k"], radius="radius", zoom=15).collect()}
    size = P.tile_size(15)
    counts = {}
    for spot in spots:
        mx, my = _mercator(*spot)
        cell = math.floor((mx + P.TILE_ORIGIN) / size), math.floor((P.TILE_ORIGIN - my) / size)
        counts[cell] = counts.get(cell, 0) + 1
    want = {}
    for k, (shape, r) in enumerate(zip(shapes, radii)):
        touched = [c for c in counts if any(_box_near(a, b, c, size, r) for a, b in zip(shape, shape[1:]))]
        if touched:
            want[k] = (len(touched), sum(counts[c] for c in touched))
    assert got == want


def _box_near(a, b, cell, size, r):
    (ax, ay), (bx, by) = _mercator(*a), _mercator(*b)
    west, north = cell[0] * size - P.TILE_ORIGIN, P.TILE_ORIGIN - cell[1] * size
    box = (west, north - size, west + size, north)
    corners = [(box[0], box[1]), (box[0], box[3]), (box[2], box[3]), (box[2], box[1])]
    inside = any(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in ((ax, ay), (bx, by)))
    if inside:
        return True

    def cross(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    for c, d in zip(corners, corners[1:] + corners[:1]):
        if cross((ax, ay), (bx, by), c) * cross((ax, ay), (bx, by), d) < 0 and cross(c, d, (ax, ay)) * cross(c, d, (bx, by)) < 0:
            return True
    gaps = [_distance(*c, ax, ay, bx, by) for c in corners]
    gaps += [math.hypot(max(box[0] - x, 0, x - box[2]), max(box[1] - y, 0, y - box[3])) for x, y in ((ax, ay), (bx, by))]
    return min(gaps) <= r
