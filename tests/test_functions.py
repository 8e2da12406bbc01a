import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geometry as G
from kerbline.functions import parsing as P
from kerbline.functions import scoring as S
from kerbline.functions import vocabulary as V
from kerbline.plans import rank as R

T = F.col("t")


def test_lenient_double(one):
    texts = ["", "abc", "nan", " -104.9 ", "inf", "NA", "1d", "0x1p3", "1_0", "1e3", ".5", "5.", "+2", None]
    got = one(texts, P.lenient_double(T))
    assert got == [None, None, None, -104.9, math.inf, None, None, None, 10.0, 1000.0, 0.5, 5.0, 2.0, None]


def test_lenient_int(one):
    got = one(["2.9", "-1.9", "x", "nan", "", "inf", "1e30", None], P.lenient_int(T))
    assert got == [2, -1, 0, 0, 0, 0, 9 * 10**18, 0]


def test_lenient_double_with_commas(one):
    got = one(["1,234.5", "491,0", " ", "nan", "None"], P.lenient_double_with_commas(T))
    assert got == [1234.5, 4910.0, None, None, None]


def test_blank_if_missing(one):
    assert one(["NA", "nan", None, "x", " NA", "#N/A"], P.blank_if_missing(T)) == ["", "", "", "x", " NA", ""]


def test_times(one):
    texts = [
        "2024-03-01T13:05:00+02:00", "2024-03-01", "03/01/2024 01:05:00 PM", "zz", "2013/01/01 05:00:00+00",
        "3/1/2024 13:05", "2024-02-30", "2024-03-01 01:02:03.1234567Z", "3/1/2024 12:05 AM", "3/1/2024 13:05 PM",
        "2024", "2024-03-01 10:00-0730", "",
    ]
    t = dt.datetime
    local = [
        t(2024, 3, 1, 13, 5), t(2024, 3, 1), t(2024, 3, 1, 13, 5), None, t(2013, 1, 1, 5), t(2024, 3, 1, 13, 5), None,
        t(2024, 3, 1, 1, 2, 3, 123456), t(2024, 3, 1, 0, 5), None, None, t(2024, 3, 1, 10), None,
    ]
    assert one(texts, P.wall_clock(T)) == local
    utc = list(local)
    utc[0], utc[11] = t(2024, 3, 1, 11, 5), t(2024, 3, 1, 17, 30)
    assert one(texts, P.utc_time(T)) == utc


def test_times_do_not_depend_on_the_session_zone(spark, one):
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:
        # 2024-03-10 02:30 does not exist in Denver.
        assert one(["2024-03-10 02:30:00"], P.utc_time(T)) == [dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hazard_status(one):
    texts = ["Closed - Done", "In Progress", "open", "Re-Opened", "", None, " Pending Closure\t", "Opened late", "closed in progress"]
    want = ["closed", "in_progress", "open", "re-opened", "unknown", "unknown", "pending_closure", "open", "closed"]
    assert one(texts, V.hazard_status(T)) == want


def test_open_hazard_patterns(one):
    texts = ["open", "In Progress", "in_progress", "closed", None, "RE-OPENED", "reopened", "waiting on customer"]
    assert one(texts, V.is_open_hazard(T)) == [True, True, True, False, False, True, False, True]


def test_hazard_category(one):
    texts = ["police report", "pothole on bike lane", "Thousand lights", "TRAFFIC LIGHT out", "path blocked", "quiet", None]
    want = ["snow_ice", "pothole", "debris", "signal", "bike_blocked", "other", "other"]
    assert one(texts, V.hazard_category(F.lit("a"), F.lit(None).cast("string"), T)) == want


def test_category_across_columns(spark):
    row = spark.sql("select 'stop' a, 'light' b, '' c").select(V.hazard_category(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == "signal"


@pytest.mark.parametrize(
    "scale,exposure,score",
    [("literal", [0.1, 0.3, 0.6, 1.0, 0.1], [1, 2, 3, 1, 1]), ("corrected", [1.0, 0.6, 0.3, 0.1, 0.1], [3, 2, 1, 1, 1])],
)
def test_severity_scales(one, scale, exposure, score):
    codes = [1, 2, 3, 4, None]
    assert one(codes, S.exposure_severity_weight(T, scale), "int") == exposure
    assert one(codes, S.score_severity_weight(T, scale), "int") == score


def test_severity_code(spark):
    df = spark.sql("select * from values (1, 1), (0, 2), (0, 0), (-1, 0) as v(f, s)")
    assert [r[0] for r in df.select(V.severity_code(F.col("f"), F.col("s"))).collect()] == [1, 2, 3, 3]


def test_recency_halves_after_24_months(one):
    assert one([0.0, 24.0, 48.0], F.round(S.recency_weight(T), 12), "double") == [1.0, 0.5, 0.25]


def test_age_in_months(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01' a, timestamp_ntz'2024-01-31' b").select(S.age_months(F.col("a"), F.col("b")))
    assert row.first()[0] == 1.0


def test_length_floor(one):
    assert one([None, 0.0, 0.5, 2500.0], S.length_km(T), "double") == [0.001, 0.001, 0.001, 2.5]


def test_scores_stay_in_range(one):
    got = one([0.0, 0.5, 1e9], S.risk_score(S.crash_points(T), S.hazard_points(T)), "double")
    assert got[0] == 0 and 0 < got[1] < 100 and got[2] == 100
    logs = one([0, 9, 99, 10**6], S.log_score(T, F.lit(99)), "bigint")
    assert logs == [0.0, 50.0, 100.0, 100.0]


def test_kilometres_round_half_up(one):
    assert one([1000.5, 8231.6, 0.0], S.kilometres(T), "double") == [1.001, 8.232, 0.0]


# --- geometry: published tile corners and a published conic ---------------------


def test_tile_square(spark):
    square = G.tile_square(F.lit(853), F.lit(1554), 12)
    row = spark.range(1).select(*[F.round(square[k], 9).alias(k) for k in ("west", "south", "east", "north")]).first()
    assert tuple(row) == (-105.029296875, 39.707186657, -104.94140625, 39.774769485)


def test_tile_square_in_mercator_units(spark):
    square = G.tile_square(F.lit(853), F.lit(1554), 12)
    row = spark.range(1).select(
        G.mercator_x(square["west"]), G.mercator_x(square["east"]), G.mercator_y(square["south"]), G.mercator_y(square["north"])
    ).first()
    want = (-11691807.84650056, -11682023.906880058, 4823482.232907763, 4833266.172528265)
    assert all(abs(a - b) < 1e-4 for a, b in zip(row, want))


def test_tile_of_its_centre(spark):
    df = spark.range(850, 860).withColumn("y", F.col("id") + 700)
    square = G.tile_square(F.col("id"), F.col("y"), 12)
    lon, lat = (square["west"] + square["east"]) / 2, (square["south"] + square["north"]) / 2
    back = df.filter(
        (G.tile_x(G.mercator_x(lon), 12) != F.col("id")) | (G.tile_y(G.mercator_y(lat), 12) != F.col("y"))
    )
    assert back.count() == 0


def test_state_plane_origin_and_inverse(spark):
    # The projection's own false origin is its latitude and longitude of origin.
    row = spark.range(1).select(G.state_plane_to_lonlat(F.lit(3e6), F.lit(1e6)).alias("p")).first().p
    assert abs(row.lon + 105.5) < 1e-9 and abs(row.lat - 37.8333333333333) < 1e-9


def test_unknown_srid():
    with pytest.raises(ValueError):
        G.to_wgs84(F.lit(None), 3857)


def test_wkt_strict(one):
    texts = ["LINESTRING(1 2,3 4)", " LINESTRING (1 2, 3 4 5) ", "linestring(1 2,3 4)", "POINT(1 2)", "LINESTRING(1,2 3)"]
    got = [[tuple(v) for v in r] for r in one(texts, G.vertices_from_wkt(T))]
    assert got == [[(1, 2), (3, 4)], [(1, 2), (3, 4)], [], [], [(2, 3)]]


def test_wkt_parts(one):
    texts = [
        "MULTILINESTRING((1 2,3 4),(5 6,7 8))", "multilinestring ( (1 2, 3 4) , (5 6, 7 8) )", "LineString Z (1 2 9, 3 4 9)",
        "LINESTRING(1,2 3)", "POINT(1 2)",
    ]
    got = [r and [[tuple(v) for v in p] for p in r] for r in one(texts, G.parts_from_wkt(T))]
    two = [[(1, 2), (3, 4)], [(5, 6), (7, 8)]]
    assert got == [two, two, [[(1, 2), (3, 4)]], None, None]


def _line(spark, *points):
    body = ", ".join(f"named_struct('lon', {x}d, 'lat', {y}d)" for x, y in points)
    return spark.sql(f"select array({body}) as v")


def test_wkt_text(spark):
    df = _line(spark, (-105.04, 39.7412), (-105.0, 39.5))
    assert df.select(G.wkt_from_vertices(F.col("v"))).first()[0] == "LINESTRING(-105.04 39.7412,-105.0 39.5)"


def test_clean_line(spark):
    df = _line(spark, (1, 1), (1, 1), (2, 2), (2, 2), (1, 1)).select(F.array("v", F.slice("v", 1, 2)).alias("p"))
    got = df.select(G.clean_line(F.col("p"))).first()[0]
    assert [[tuple(v) for v in p] for p in got] == [[(1, 1), (2, 2), (1, 1)]]


def test_geodesic_length_of_a_degree(spark):
    # One degree of latitude at 45 degrees and of longitude at 60 degrees, WGS84.
    north = _line(spark, (0, 44.5), (0, 45.5)).select(G.geodesic_length(F.array("v"))).first()[0]
    east = _line(spark, (0, 60), (1, 60)).select(G.geodesic_length(G.densify(F.array("v")))).first()[0]
    assert abs(north - 111131.8) < 5
    assert abs(east - 55799.5) < 60


def test_densify_works_out_an_arc_once(spark):
    """Not once for each weight and coordinate of each new vertex: nothing in a lambda is shared by the engine."""
    df = _line(spark, (0, 0), (1, 0)).select(G.densify(F.array("v"), 40_000.0).alias("d"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("asin(") == 1
    assert [round(v["lon"], 9) for v in df.first()[0][0]] == [0, round(1 / 3, 9), round(2 / 3, 9), 1]


def test_densify_keeps_short_segments(spark):
    df = _line(spark, (-105.0, 39.7), (-105.001, 39.7), (-105.001, 39.73))
    got = [tuple(v) for v in df.select(G.densify(F.array("v"))).first()[0][0]]
    assert got[:2] == [(-105.0, 39.7), (-105.001, 39.7)] and got[-1] == (-105.001, 39.73)
    assert len(got) == 2 + 4  # 3.3 km in four pieces
    assert all(abs(x + 105.001) < 1e-12 for x, _ in got[1:])


# --- result texts ---------------------------------------------------------------


def test_comparison_texts(one):
    assert one([2, 1, 0, -1, -3], R.crash_text(T), "int") == [
        "+2 more crashes", "+1 more crash", "0 fewer crashes", "1 fewer crash", "3 fewer crashes",
    ]
    assert one([1.26, 0.0, -0.5], R.length_text(T), "double") == ["+1.3 km longer", "0.0 km shorter", "0.5 km shorter"]


def test_risk_ranks(one):
    risks = one([1, 2, 3, 4, 9], R.risk_rank(T), "int")
    assert risks == [-1, 0, 1, 2, 2]
    assert one(risks, R.risk_class(T), "int") == ["winner", "medium", "high", "high", "high"]
    assert one(["winner", "medium", "high"], R.badge(T)) == ["Best Route", "Average Risk", "Higher Risk"]
