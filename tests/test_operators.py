import datetime as dt
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import alternatives as A
from kerbline.operators import collections as C
from kerbline.operators import skew
from kerbline.operators.merge import upsert, upsert_bikeway, upsert_crash, upsert_hazard
from kerbline.operators.quality import key_violations
from kerbline.operators.requests import checked_requests, rejected_requests, valid_requests
from kerbline.operators.tiles import busiest_tile, crash_tiles, tile_at, tile_features, top_tiles
from kerbline.plans import rank as R
from kerbline.plans import risk as K

LINE = "array<array<struct<lon:double,lat:double>>>"


def _skewed(spark, n=600):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 17}", rng.randint(0, 3), float(rng.randint(0, 5)), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, a int, b double, i int")


@pytest.mark.parametrize("batch", [10_000, 7])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_rank_in_group_is_a_row_number(spark, batch, coalesce):
    df = _skewed(spark)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.adaptive.coalescePartitions.enabled": coalesce}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = skew.rank_in_group(df, ["g"], ["a", "b", "i"], first={"best": "i"}).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.a, r.b, r.i))
    want = {}
    for g, keys in groups.items():
        for n, (_, _, i) in enumerate(sorted(keys), 1):
            want[i] = (g, n, min(keys)[2])
    assert {r.i: (r.g, r["rank"], r.best) for r in got} == want


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 3, 3), ("", 4, 9), ("", 5, 8)], "id string, v int, p int")
    assert sorted(map(tuple, skew.first_per_key(df, ["id"], F.col("p")).select("id", "v").collect())) == [("", 5), ("a", 2), ("b", 3)]
    assert sorted(map(tuple, skew.first_per_key(df, ["id"], F.col("p"), last=True).select("id", "v").collect())) == [("", 4), ("a", 1), ("b", 3)]


# --- merges ---------------------------------------------------------------------


def test_upsert_twice_changes_nothing(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "crash_id string, occurred_at timestamp_ntz, severity smallint, lon double, lat double"
    old = spark.createDataFrame([("1", t, 1, 1.0, 1.0), ("2", t, 2, 2.0, 2.0)], schema)
    new = spark.createDataFrame([("2", None, 3, 9.0, 9.0), ("3", t, 1, 3.0, 3.0)], schema)
    once = upsert_crash(old, new)
    want = [("1", t, 1, 1.0, 1.0), ("2", None, 3, 9.0, 9.0), ("3", t, 1, 3.0, 3.0)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert_crash(once, new).collect())) == want
    assert once.schema.simpleString() == old.schema.simpleString()


def test_hazard_times_survive_null(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    schema = "hazard_id string, category string, status string, opened_at timestamp_ntz, closed_at timestamp_ntz, lon double, lat double"
    old = spark.createDataFrame([("1", "x", "open", a, b, 0.0, 0.0), ("2", "x", "open", a, None, 0.0, 0.0)], schema)
    new = spark.createDataFrame([("1", "y", None, None, None, 1.0, 1.0), ("2", "y", "closed", b, b, 1.0, 1.0)], schema)
    got = sorted(map(tuple, upsert_hazard(old, new).collect()))
    assert got == [("1", "y", None, a, b, 1.0, 1.0), ("2", "y", "closed", b, b, 1.0, 1.0)]


def test_bikeway_key_name_of_the_target(spark):
    schema = f"way_id string, class string, on_off string, status string, parts {LINE}"
    old = spark.createDataFrame([("1", "a", "", "X", [])], schema)
    new = old.selectExpr("'2' as infra_id", "class", "on_off", "status", "parts")
    assert sorted(r.way_id for r in upsert_bikeway(old, new, "way_id").collect()) == ["1", "2"]


def test_upsert_with_two_keys(spark):
    old = spark.createDataFrame([("u", "r", 1)], "user_id string, route_id string, v int")
    new = spark.createDataFrame([("u", "r", 2), ("u", "s", 3)], "user_id string, route_id string, v int")
    assert sorted(map(tuple, upsert(old, new, ["user_id", "route_id"]).collect())) == [("u", "r", 2), ("u", "s", 3)]


def test_key_violations(spark):
    df = spark.createDataFrame([("1", 1.0), ("1", None), (None, 2.0), ("2", 3.0)], "id string, lon double")
    got = {(r.id, r.problem, r.rows) for r in key_violations(df, ["id"], ["lon"]).collect()}
    assert got == {("1", "repeated key", 2), ("1", "missing value", 1), (None, "null key", 1)}


# --- requests and ranking ---------------------------------------------------------

REQUEST = "request_id int, start array<double>, end array<double>, buffer_m double, max_alternatives int, mode string, use_fixture boolean"
ROUTE = "request_id int, index int, vertices array<struct<lon:double,lat:double>>, distance double, duration double, legs array<struct<distance:double>>"


def _requests(spark, *rows):
    s, e = [-105.0, 39.7], [-104.99, 39.7]
    return spark.createDataFrame([(i, s, e, b, m, mode, None) for i, b, m, mode in rows], REQUEST)


def test_places_and_buffers_must_be_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [None, 1.0], [1.0, 2.0], 60.0), (2, [1.0, 2.0], [1.0], 60.0), (3, [1.0, nan], [1.0, 2.0], 60.0), (4, [1.0, 2.0], [1.0, 2.0], inf), (5, [1.0, 2.0], [1.0, 2.0], 60.0)]
    df = spark.createDataFrame([(*r, 3, None, None) for r in rows], REQUEST)
    assert {r.request_id: r.error for r in checked_requests(df).collect()} == {1: "start", 2: "end", 3: "start", 4: "buffer_m", 5: None}


def test_request_checks(spark):
    rows = [(1, None, None, "Driving"), (2, 60.0, 3, "bus"), (3, -1.0, 3, None), (4, 0.0, 0, None), (5, 0.0, 6, None), (6, float("nan"), 1, None)]
    df = _requests(spark, *rows).unionByName(spark.createDataFrame([(7, None, [1.0, 2.0], None, None, None, True)], REQUEST))
    got = {r.request_id: r.error for r in checked_requests(df).collect()}
    assert got == {1: None, 2: "mode", 3: "buffer_m", 4: "max_alternatives", 5: "max_alternatives", 6: "buffer_m", 7: "start"}
    row = valid_requests(df).collect()
    assert [(r.request_id, r.buffer_m, r.max_alternatives, r.mode, r.use_fixture) for r in row] == [(1, 60.0, 3, "driving", False)]
    assert rejected_requests(df).count() == 6


def _routes(spark, rows):
    return spark.createDataFrame(
        [(q, i, [{"lon": x, "lat": y} for x, y in v], d, 1.0, legs and [{"distance": m} for m in legs]) for q, i, v, d, legs in rows], ROUTE
    )


WEST = [(-105.0, 39.7), (-104.999, 39.7)]
EAST = [(-104.9, 39.7), (-104.899, 39.7)]


def _ranking(spark):
    requests = _requests(spark, (1, 60.0, 3, None), (2, 60.0, 3, "cycling"), (3, 60.0, 3, "bus"), (4, 60.0, 3, None))
    routes = _routes(
        spark,
        [
            (1, 0, WEST, 900.0, None), (1, 1, [], 1.0, None), (1, 2, EAST, None, [500.0, None, 100.4]),
            (1, 3, EAST, 600.4, None), (1, 4, EAST, None, None), (3, 0, EAST, 1.0, None), (4, 0, [], 5.0, None),
        ],
    )
    crash = spark.createDataFrame([(-105.0, 39.7), (-105.0, 39.7), (-104.9995, 39.7004)], "lon double, lat double")
    return requests, routes, crash, R.rank_routes(requests, routes, crash, keep_vertices=True)


def test_rank_routes(spark):
    requests, routes, crash, ranked = _ranking(spark)
    got = [(r.request_id, r["index"], r["rank"], r.crashes, r.length_km, r.winner, r.is_winner) for r in ranked.orderBy("request_id", "rank").collect()]
    # No coordinates: index 1 is used up. No length: 0 km. Equal length: lower index first.
    assert got == [(1, 4, 1, 0, 0.0, 4, True), (1, 2, 2, 0, 0.6, 4, False), (1, 3, 3, 0, 0.6, 4, False), (1, 0, 4, 3, 0.9, 4, False)]


def test_winners_keep_empty_requests(spark):
    requests, routes, crash, _ = _ranking(spark)
    got = {r.request_id: (r.winner, r.routes) for r in R.winners(requests, R.scored_routes(requests, routes, crash)).collect()}
    assert got == {1: (4, 4), 2: (None, 0), 4: (None, 0)}


def test_enriched_and_documents(spark):
    *_, ranked = _ranking(spark)
    rows = {r["index"]: r for r in R.enriched(ranked).collect()}
    assert [rows[i].risk_rank for i in (4, 2, 3, 0)] == [-1, 0, 1, 2]
    assert (rows[0].crash_text, rows[0].length_text) == ("+3 more crashes", "+0.9 km longer")
    assert rows[4].crash_text is None
    pages = C.pages(R.route_features(ranked), ["request_id"], "rank", per_page=3).orderBy("page").collect()
    documents = [json.loads(p.document) for p in pages]
    assert [len(d["features"]) for d in documents] == [3, 1]
    first = documents[0]["features"][0]
    assert first["geometry"] == {"type": "LineString", "coordinates": [list(p) for p in EAST]}
    assert first["properties"] == {"index": 4, "crashes": 0, "length_km": 0.0, "is_winner": True}
    lines = [json.loads(r.value) for r in C.feature_lines(R.route_features(ranked)).collect()]
    assert {f["type"] for f in lines} == {"Feature"} and len(lines) == 4


def test_request_boxes(spark):
    requests, routes, *_ = _ranking(spark)
    got = {r.request_id: tuple(r)[1:] for r in R.request_boxes(requests, routes).collect()}
    assert got == {1: (-105.0, 39.7, -104.899, 39.7)}


# --- tiles and documents ------------------------------------------------------------


def test_tiles(spark):
    crash = spark.createDataFrame([(-104.98, 39.74)] * 3 + [(-104.9, 39.74)], "lon double, lat double")
    tiles = crash_tiles(crash)
    assert sorted(map(tuple, tiles.collect())) == [(853, 1554, 3), (854, 1554, 1)]
    assert busiest_tile(tiles).first()[0] == 3
    assert busiest_tile(tiles.filter("false")).first()[0] == 1
    order = [-F.col("crashes"), F.col("x"), F.col("y")]
    top = json.loads(C.single_document(tile_features(top_tiles(tiles, 5)), order, 5).first()[0])
    assert [f["properties"] for f in top["features"]] == [{"x": 853, "y": 1554, "crashes": 3}, {"x": 854, "y": 1554, "crashes": 1}]
    ring = top["features"][0]["geometry"]["coordinates"][0]
    assert ring[0] == ring[4] == [-105.029297, 39.707187] and ring[2] == [-104.941406, 39.774769]
    empty = C.single_document(tile_features(tile_at(tiles, 0, 0)), order, 1).first()[0]
    assert json.loads(empty) == {"type": "FeatureCollection", "features": None}
    with pytest.raises(ValueError):
        C.single_document(tile_features(tiles), order, 0)


def test_a_document_holds_the_first_features(spark):
    features = spark.range(30).repartition(5).select("id", F.struct("id").alias("feature"))
    document = C.single_document(features, [-F.col("id")], 3).first()[0]
    assert [f["id"] for f in json.loads(document)["features"]] == [29, 28, 27]
    whole = C.single_document(features, [F.col("id")], 20_000).first()[0]
    assert len(json.loads(whole)["features"]) == 30


def _put_together(parts):
    return "".join(r.text for r in parts.orderBy("part").collect())


def test_parts_are_one_document_per_key(spark):
    rng = random.Random(3)
    rows = [(k, i + 1) for k, n in (("hot", 2501), ("even", 200), ("one", 1)) for i in range(n)]
    rng.shuffle(rows)
    features = spark.createDataFrame([*rows, ("unplaced", None)], "k string, p int").repartition(7).withColumn("feature", F.struct("k", "p", F.lit(None).cast("int").alias("none")))
    parts = C.document_parts(features, ["k"], "p", 100).cache()
    assert sorted({r.k for r in parts.collect()}) == ["even", "hot", "one"]
    assert {(r.k, r.n) for r in parts.groupBy("k").agg(F.count("*").alias("n")).collect()} == {("hot", 27), ("even", 3), ("one", 2)}
    for k, n in (("hot", 2501), ("even", 200), ("one", 1)):
        got = json.loads(_put_together(parts.filter(F.col("k") == k)))
        assert got == {"type": "FeatureCollection", "features": [{"k": k, "p": i + 1, "none": None} for i in range(n)]}
    assert max(r.text.count('"k"') for r in parts.collect()) == 100
    assert C.document_parts(features.filter("false"), ["k"], "p").collect() == []
    with pytest.raises(ValueError):
        C.document_parts(features, ["k"], "p", 0)


def test_files_of_a_document_that_no_row_could_hold(spark, tmp_path):
    """Far more text than a part holds, in several files that follow each other."""
    long = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.sha2(F.concat("id", F.lit(" "), k), 256)))
    features = spark.range(20_000).select((F.col("id") + 1).alias("p"), F.struct("id", long.alias("note")).alias("feature"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "8m")
    try:
        C.write_document(C.document_parts(features, [], "p", 50), str(tmp_path / "doc"))
    finally:
        spark.conf.set(size, before)
    files = sorted((tmp_path / "doc").glob("part-*"))
    assert len(files) > 1 and sum(f.stat().st_size for f in files) > 40_000_000
    got = json.loads("".join(f.read_text() for f in files))
    assert [f["id"] for f in got["features"]] == list(range(20_000))


def test_tiles_by_parts(spark):
    from kerbline.workload.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    got = json.loads(_put_together(QUERIES["tile_document_parts"](spark, sf)))["features"]
    counts = [f["properties"]["crashes"] for f in got]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 1000


def test_points_off_the_map_have_no_tile(spark):
    inf = float("inf")
    crash = spark.createDataFrame([(-105.0, 39.7), (-105.0, 95.0), (-105.0, 95.0), (inf, 39.7), (None, 39.7), (float("nan"), 1.0), (-105.0, 90.0)], "lon double, lat double")
    assert busiest_tile(crash_tiles(crash)).first()[0] == 1


# --- risk ---------------------------------------------------------------------------


def _risk_world(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    t, old = dt.datetime(2024, 1, 15), dt.datetime(2020, 1, 1)
    crash = spark.createDataFrame(
        [("1", t, 3, -105.0, 39.7), ("2", t, 2, -105.0, 39.7), ("3", old, 3, -105.0, 39.7), ("4", t, 1, -105.0, 39.7009)],
        "crash_id string, occurred_at timestamp_ntz, severity smallint, lon double, lat double",
    )
    hazard = spark.createDataFrame(
        [
            ("1", "other", "In Progress", t, None, -105.0, 39.7), ("2", "other", "closed", t, None, -105.0, 39.7),
            ("3", "other", "open", None, None, -105.0, 39.7), ("4", "other", "open", t, old, -105.0, 39.7),
            ("5", "other", "open", t, t, -105.0, 39.7),
        ],
        "hazard_id string, category string, status string, opened_at timestamp_ntz, closed_at timestamp_ntz, lon double, lat double",
    )
    shape = [{"lon": -105.0, "lat": 39.7}, {"lon": -104.99, "lat": 39.7}]
    far = [{"lon": -100.0, "lat": 39.7}, {"lon": -100.0, "lat": 39.7}]
    lines = spark.createDataFrame([("near", [shape]), ("far", [far])], f"infra_id string, parts {LINE}")
    return lines, crash, hazard, now


def test_score_lines(spark):
    lines, crash, hazard, now = _risk_world(spark)
    got = {r.infra_id: r for r in K.score_bikeway(lines, crash, hazard, now=now).collect()}
    near = got["near"]
    assert (near.crashes, near.crash_weight, near.open_hazards) == (2, 5, 2)
    points = 60 * (1 - math.exp(-5 / near.length_km / 1.5)) + 40 * (1 - math.exp(-2 / near.length_km / 3))
    assert 0.85 < near.length_km < 0.86 and near.score == math.ceil(points)
    # A line without length has the floor length and nothing near it.
    assert (got["far"].length_km, got["far"].score) == (0.001, 0)
    wide = K.score_bikeway(lines, crash, hazard, infra_id="near", now=now, buffer_m=110.0, scale="corrected").collect()
    assert [(r.crashes, r.crash_weight) for r in wide] == [(3, 1 + 2 + 3)]
    assert K.score_bikeway(lines, crash, hazard, infra_id="none", now=now).count() == 0


def test_score_reaches_one_hundred(spark):
    lines, crash, hazard, now = _risk_world(spark)
    many = crash.filter("crash_id = '1'").crossJoin(spark.range(500)).selectExpr("cast(id as string) crash_id", "occurred_at", "severity", "lon", "lat")
    more = hazard.filter("hazard_id = '1'").crossJoin(spark.range(500)).selectExpr("cast(id as string) hazard_id", "category", "status", "opened_at", "closed_at", "lon", "lat")
    assert K.score_bikeway(lines, many, more, infra_id="near", now=now).first().score == 100


def test_payload_and_wkt(spark):
    lines, crash, hazard, now = _risk_world(spark)
    texts = spark.createDataFrame([(1, "LINESTRING(-105 39.7,-104.99 39.7)"), (2, "nonsense")], "k int, wkt string")
    scored = K.score_wkt(texts, crash, hazard, now=now, key=["k"])
    payload = [json.loads(r.payload) for r in K.risk_payload(scored, ["k"]).collect()]
    assert len(payload) == 1 and payload[0]["counts"] == {"crashes": 2, "crash_weight": 5, "open_hazards": 2}
    assert payload[0]["params"] == {"lookback_days": 365, "buffer_m": 50.0} and payload[0]["score"] == 81


def test_log_scores(spark):
    lines, crash, hazard, now = _risk_world(spark)
    got = {r.infra_id: (r.crashes, r.score) for r in K.log_scores(lines, crash, crash_tiles(crash), key=["infra_id"], buffer=60.0).collect()}
    assert got == {"near": (3, 86.14), "far": (0, 0.0)}


def test_weights_of_unknown_rows(spark):
    crash = spark.createDataFrame([("1", None, None), ("2", dt.datetime(2024, 1, 1), 4)], "crash_id string, occurred_at timestamp_ntz, severity smallint")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    got = {r.crash_id: (r.sev_w, r.weight) for r in K.crash_weights(crash, now).collect()}
    assert got == {"1": (0.1, None), "2": (1.0, 1.0)}


# --- alternatives ---------------------------------------------------------------------


def test_waypoints(spark):
    requests = spark.createDataFrame([(1, [0.0, 0.0], [2.0, 1.0], 2, 4)], "request_id int, start array<double>, end array<double>, have int, want int")
    def rounded(df):
        return [(r.kind, r.step, round(r.lon, 6), round(r.lat, 6)) for r in df.collect()]

    assert rounded(A.compass_waypoints(requests)) == [
        ("compass", 0, 1.0, 0.52), ("compass", 1, 1.0, 0.48), ("compass", 2, 1.02, 0.5), ("compass", 3, 0.98, 0.5),
    ]
    assert rounded(A.east_west_waypoints(requests, "have", "want")) == [("east_west", 2, 1.03, 0.5), ("east_west", 3, 0.96, 0.5)]
    assert rounded(A.east_west_waypoints(requests, "want", "have")) == []
    for vertices, want in (
        ([(0.0, 0.0), (2.0, 1.0)], [("on_line", 0, 1.005, 0.5), ("on_line", 1, 0.995, 0.5)]),
        ([(0.0, 0.0), (1.0, 9.0), (1.5, 8.0), (2.0, 1.0)], [("on_line", 0, 1.005, 8.99), ("on_line", 1, 1.495, 8.01)]),
    ):
        shape = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in vertices])
        assert rounded(A.on_line_waypoints(requests.withColumn("vertices", shape))) == want


WAY = [{"lon": 1.0, "lat": 2.0}]
VERTICES = "vertices array<struct<lon:double,lat:double>>"


def test_distinct_enough(spark):
    candidates = spark.createDataFrame(
        [
            (1, 0, "compass", 103.0, WAY), (1, 1, "compass", 104.0, WAY), (1, 2, "on_line", 105.0, WAY), (1, 3, "on_line", 94.0, WAY),
            (1, 4, "east_west", 100.0, WAY), (1, 5, "other", 900.0, WAY), (1, 6, "east_west", 100.0, []), (1, 7, "compass", 900.0, None),
            (2, 8, "compass", 900.0, WAY), (2, 9, "on_line", 900.0, WAY),
        ],
        f"request_id int, index int, kind string, distance double, {VERTICES}",
    )
    primary = spark.createDataFrame([(1, 100.0, WAY), (2, 100.0, [])], f"request_id int, distance double, {VERTICES}")
    assert sorted(r["index"] for r in A.distinct_enough(candidates, primary).collect()) == [1, 3, 4, 9]


@pytest.mark.parametrize("most, want", [(None, [(1, 0, 10), (1, 1, 11), (1, 2, 5), (1, 3, 4), (2, 0, 12), (3, 0, 13), (3, 1, 14)]), (3, [(1, 0, 10), (1, 1, 11), (1, 2, 5), (2, 0, 12), (3, 0, 13), (3, 1, 14)])])
def test_more_routes_come_by_kind_until_there_are_enough(spark, most, want):
    requests = _requests(spark, (1, 60.0, 4, None), (2, 60.0, 1, None), (3, 60.0, 1, None))
    routes = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (3, 14)], "request_id int, was int")
    extra = spark.createDataFrame(
        [(1, "east_west", 1), (1, "on_line", 4), (1, "compass", 5), (2, "compass", 6)], "request_id int, kind string, was int"
    )
    got = A.with_more_routes(requests, routes, extra, "was", most).collect()
    assert sorted((r.request_id, r["index"], r.was) for r in got) == want


@pytest.mark.parametrize(
    "how,shifts,stretch",
    [("zigzag", [(0.001, -0.001), (0.002, -0.002)], [1.05, 1.10]), ("shift", [(0.002, 0.002), (-0.004, -0.004)], [1.1, 1.2])],
)
def test_padding(spark, how, shifts, stretch):
    requests = _requests(spark, (1, 60.0, 3, None), (2, 60.0, 3, None), (3, 60.0, 1, None))
    routes = _routes(spark, [(1, 0, WEST, 100.0, None), (2, 0, [], 1.0, None), (3, 0, EAST, 1.0, None), (3, 1, EAST, 1.0, None)])
    got = A.pad_alternatives(requests, routes, how).orderBy("request_id", "index").collect()
    assert [(r.request_id, r["index"], r.is_synthetic) for r in got] == [(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (3, 0, False), (3, 1, False)]
    for row, (even, odd), factor in zip(got[1:3], shifts, stretch):
        assert [round(v.lat, 6) for v in row.vertices] == [round(39.7 + even, 6), round(39.7 + odd, 6)]
        assert round(row.distance, 6) == round(100 * factor, 6)
