"""Points in strips: few are tested one by one, and all are counted once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.functions.geometry import LINE_TYPE, densify, geodesic_length
from kerbline.operators import lengths
from kerbline.operators.lengths import with_metres
from kerbline.operators.strips import Strips
from kerbline.plans.risk import score_wkt


def _brute(x, y, kx, ky, a, b, c, d, r):
    u, v, c, d = (x - a) * kx, (y - b) * ky, c * kx, d * ky
    t = np.clip((u * c + v * d) / np.maximum(c * c + d * d, 1e-300), 0, 1)
    return np.hypot(u - t * c, v - t * d) <= r


@pytest.mark.parametrize("planar", [True, False])
@pytest.mark.parametrize("points", [1, 40, 30_000])
def test_totals_equal_brute_force_with_few_tests(planar, points, monkeypatch):
    rng = np.random.default_rng(points)
    x, y = rng.random((2, points)) * 2000.0
    x[: points // 10] = x[0]
    kx, ky = 1.0 + y / 20_000, 1.0 + y / 50_000
    values = [rng.integers(-5, 9, points), rng.random(points)]
    strips = Strips(x, y, None if planar else kx, None if planar else ky, values, planar)
    if planar:
        kx = ky = np.ones(points)
    line = np.repeat(np.arange(60), 4)
    a, b = rng.random((2, 240)) * 2600 - 300
    c, d = rng.normal(0, 400, (2, 240))
    a[1::4], b[1::4], c[2::4], d[3::4] = a[::4] + c[::4], b[::4] + d[::4], 0.0, 0.0
    r = rng.choice([0.5, 60.0, 300.0], 60)[line]
    c[::40] = d[::40] = 0.0
    tested = []
    test = Strips._hits
    monkeypatch.setattr(Strips, "_hits", lambda self, point, *s: tested.append(len(point)) or test(self, point, *s))
    count, sums = strips.totals(line, np.stack([a, b, c, d, r]))
    for k in range(60):
        near = np.any([_brute(x, y, kx, ky, *(z[s] for z in (a, b, c, d, r))) for s in np.flatnonzero(line == k)], axis=0)
        assert count[k] == near.sum()
        assert sums[0][k] == values[0][near].sum()
        assert float(sums[1][k]) == pytest.approx(values[1][near].sum(), abs=1e-9)
    if points > 1000:
        assert sum(tested) < count.sum() / 2


def test_values_that_are_not_finite():
    x, y = np.random.default_rng(3).random((2, 5000)) * 500.0
    value = np.ones(5000)
    value[np.argmin(np.hypot(x - 250, y - 250))] = np.inf
    strips = Strips(x, y, None, None, [value], True)
    segments = np.array([[250.0, 20.0], [250.0, 20.0], [50.0, 5.0], [0.0, 0.0], [100.0, 10.0]])
    count, sums = strips.totals(np.array([0, 1]), segments)
    assert np.isinf(sums[0][0]) and sums[0][1] == count[1] > 0


def test_a_text_is_parsed_once_for_its_points_and_once_for_its_length(spark):
    lines = spark.createDataFrame([(1, "LINESTRING(0 0, 0 1)"), (2, "x"), (3, None)], "k int, wkt string")
    crash = spark.createDataFrame([], "lon double, lat double, severity smallint, occurred_at timestamp_ntz")
    hazard = spark.createDataFrame([], "lon double, lat double, status string, opened_at timestamp_ntz, closed_at timestamp_ntz")
    scored = score_wkt(lines, crash, hazard, now=F.lit("2024-01-01").cast("timestamp_ntz"), key=["k"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MULTILINESTRING") == 4  # tested for and taken apart, twice
    assert [r.k for r in scored.collect()] == [1]


def test_lengths_of_a_batch_equal_the_column(spark):
    far = [[(10.0, 45.0), (13.0, 45.5), (13.0, 45.5001)], [(170.0, -80.0), (-170.0, -79.0)]]
    rows = [
        (1, far), (2, [[(-105.0, 39.7), (-105.001, 39.701), (-105.02, 39.71)]]), (3, []), (4, None), (5, [[(1.0, 2.0)]]),
        (6, [[(1.0, 2.0), None]]), (7, [[(1.0, None), (1.0, 2.0)]]), (8, [None, [(0.0, 0.0), (0.0, 1.0)]]), (9, [[(0.0, 0.0), (float("nan"), 0.0)]]),
        (10, [[(0.0, 0.0), (0.0, 0.0)]]), (None, [[(0.0, 0.0), (0.001, 0.0)]]),
    ]
    lines = spark.createDataFrame(rows, f"k int, parts {LINE_TYPE}")
    want = {r.k: r.m for r in lines.select("k", geodesic_length(densify(F.col("parts"))).alias("m")).collect()}
    got = {r.k: r.metres for r in with_metres(lines).collect()}
    assert set(got) == set(want) and got[1] > 300_000
    for k, m in want.items():
        assert (got[k] is None) == (m is None), k
        assert m is None or got[k] == pytest.approx(m, rel=1e-9, nan_ok=True), k


def test_long_segments_are_measured_in_portions(monkeypatch):
    parts = pa.array([[[{"lon": float(k), "lat": 50.0}, {"lon": k + 0.5, "lat": 50.2}]] for k in range(9)])
    whole = lengths.line_metres(parts).to_pylist()
    monkeypatch.setattr(lengths, "PIECES", 50)
    assert lengths.line_metres(parts).to_pylist() == whole and lengths.line_metres(parts.slice(4, 2)).to_pylist() == whole[4:6]
