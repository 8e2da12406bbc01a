"""Lines laid out over blocks: the same blocks and segments as by columns, in few rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.functions.geometry import LINE_TYPE
from kerbline.operators import blocks, proximity
from kerbline.operators.strips import Strips

NAN, INF = float("nan"), float("inf")
ODD = [
    None, [], [None], [[]], [[(1.0, 2.0)]], [[(1.0, 2.0), None, (1.0, 2.001)]], [[(1.0, 2.0), (1.0, None)]], [[(0.0, 0.0), (0.001, 0.0)], None],
    [[(0.0, 0.0), (NAN, 0.0), (0.001, 0.0), (0.002, 0.0)]], [[(0.0, 0.0), (INF, 0.0)]], [[(5.0, 5.0), (5.0, 5.0)]], [[(10.0, 45.0), (10.2, 45.1)]],
    [[(7.0, 50.0), (7.01, 50.0), (7.01, 50.01)], [(7.01, 50.01), (7.02, 50.03)], [(9.0, 50.0), (9.001, 50.0)]],
]


@pytest.mark.parametrize("metric", ["mercator", "geodesic"])
@pytest.mark.parametrize("radius", [60.0, 0.0])
def test_rows_hold_the_segments_of_each_block(spark, metric, radius):
    rng = np.random.default_rng(4)
    walks = [[[tuple(map(float, v)) for v in np.cumsum(rng.normal(0, 0.01, (7, 2)), 0) + (-105.0, 39.7)]] for _ in range(40)]
    rows = [(k, p) for k, p in enumerate([*ODD, *walks])]
    lines = spark.createDataFrame(rows, f"k int, parts {LINE_TYPE}").withColumn("radius", F.lit(radius)).withColumn("z", F.lit(15))
    digits = 3 if metric == "mercator" else 10
    near = lambda s: tuple(round(float(v), digits) + 0.0 for v in s)
    want = sorted((r.k, r.cell, near(r.seg)) for r in proximity.line_cells(lines, ["k"], "parts", "radius", metric, "z").collect())
    parts = pa.array([None if p is None else [None if q is None else [None if v is None else {"lon": v[0], "lat": v[1]} for v in q] for q in p] for _, p in rows], pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
    with np.errstate(invalid="ignore", divide="ignore"):
        line, block, packed = blocks.laid_out(parts, np.full(len(rows), radius), np.full(len(rows), 15), metric == "mercator")
    row, segments = blocks.segments_of(packed, metric == "mercator")
    assert sorted((int(line[r]), int(block[r]), near(s)) for r, s in zip(row, segments.T, strict=True)) == want
    assert len(set(zip(line.tolist(), block.tolist(), strict=True))) == len(line)
    assert (radius == 0) == (not len(line)) or metric == "geodesic" and 2 * len(line) < len(want) + 20
    row, segments = blocks.segments_of(packed.slice(len(packed) // 2), metric == "mercator")
    assert set(row) == set(range(len(packed) - len(packed) // 2))


@pytest.mark.parametrize("planar", [True, False])
def test_few_points_need_the_exact_test(planar, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.random((2, 40_000)) * (1200.0 if planar else 2e-4) + (0.0 if planar else 0.7)
    kx, ky = 6.4e6 * np.cos(y), np.full(len(y), 6.36e6)
    strips = Strips(x, y, None if planar else kx, None if planar else ky, [np.ones(len(x), np.int64)], planar)
    scale = 1.0 if planar else 1.6e-7
    a, b = rng.random((2, 50)) * 1000 * scale + (0.0 if planar else 0.7)
    c, d = rng.normal(0, 500, (2, 50)) * scale
    tested = []
    test = Strips._hits
    monkeypatch.setattr(Strips, "_hits", lambda self, point, *s: tested.append(len(point)) or test(self, point, *s))
    count, sums = strips.totals(np.arange(50), np.stack([a, b, c, d, np.full(50, 60.0)]))
    kx, ky = (1.0, 1.0) if planar else (kx, ky)
    for k in range(50):
        u, v, p, q = (x - a[k]) * kx, (y - b[k]) * ky, c[k] * kx, d[k] * ky
        t = np.clip((u * p + v * q) / (p * p + q * q), 0, 1)
        assert count[k] == sums[0][k] == (np.hypot(u - t * p, v - t * q) <= 60.0).sum()
    assert sum(tested) < count.sum() / 25
