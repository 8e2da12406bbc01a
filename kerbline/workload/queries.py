"""Named queries over the derived tables, one per feature, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geometry as G
from kerbline.functions.geojson import tile_geometry
from kerbline.functions.parsing import lenient_double, lenient_double_with_commas, lenient_int, utc_time, wall_clock
from kerbline.functions.scoring import exposure_severity_weight, score_severity_weight
from kerbline.functions.vocabulary import hazard_category, hazard_status, severity_code
from kerbline.operators import alternatives as alt
from kerbline.operators import collections as col
from kerbline.operators import tiles as til
from kerbline.operators.merge import upsert_bikeway, upsert_crash, upsert_hazard
from kerbline.operators.proximity import totals_near_lines
from kerbline.operators.quality import key_violations
from kerbline.operators.requests import checked_requests, valid_requests
from kerbline.operators.skew import first_per_key, rank_in_group
from kerbline.plans import ingest, risk
from kerbline.plans import rank as rk
from kerbline.sources.routes import explode_routes
from kerbline.sql import register
from kerbline.streaming.alerts import hazard_alerts, hazard_digests, watch_cells
from kerbline.streaming.load import current_table
from kerbline.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUFFER = 60.0


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _rank_inputs(s, d):
    return t.request(s, d), t.route(s, d), t.crash(s, d)


# --- ranking -------------------------------------------------------------------


@query
def rank_routes(s, d):
    """Alternatives of every valid request by crashes, length, index."""
    return rk.rank_routes(*_rank_inputs(s, d)).select(
        "request_id", "mode", "index", "length_km", "crashes", "rank", "is_winner"
    )


@query
def rank_winners(s, d):
    """Winner per valid request, null for requests without routes."""
    requests, routes, crash = _rank_inputs(s, d)
    return rk.winners(requests, rk.scored_routes(requests, routes, crash))


@query
def rank_enriched(s, d):
    """Ranks with risk class, badge and comparison to the winner."""
    return rk.enriched(rk.rank_routes(*_rank_inputs(s, d))).select(
        "request_id", "index", "risk_rank", "risk_class", "badge", "crash_difference", "km_difference",
        "crash_text", "length_text",
    )


@query
def rank_feature_collection(s, d):
    """Ranked routes as GeoJSON documents per request."""
    ranked = rk.rank_routes(*_rank_inputs(s, d), keep_vertices=True)
    return col.pages(rk.route_features(ranked), ["request_id"], "rank")


@query
def rank_feature_values(s, d):
    """The ranking's documents read back: a row per feature with its place in the
    document, its properties, and its line as number and rounded sums of vertices."""
    kind = (
        "type string, features array<struct<type: string, geometry: struct<type: string, coordinates: array<array<double>>>,"
        " properties: struct<index: int, crashes: bigint, length_km: double, is_winner: boolean>>>"
    )
    read = rank_feature_collection(s, d).select("request_id", F.from_json("document", kind).alias("d"))
    features = read.select("request_id", F.col("d.type").alias("document"), F.posexplode("d.features").alias("place", "f"))
    line = F.col("f.geometry.coordinates")
    total = lambda k: F.round(F.aggregate(line, F.lit(0.0), lambda a, v: a + v[k]), 6)
    return features.select(
        "request_id", "document", "place", "f.properties.*", F.col("f.geometry.type").alias("shape"), F.size(line).alias("vertices"),
        total(0).alias("lon_sum"), total(1).alias("lat_sum"),
    )


@query
def request_summary(s, d):
    return rk.request_summary(rk.scored_routes(*_rank_inputs(s, d)))


@query
def route_bbox(s, d):
    return rk.request_boxes(t.request(s, d), t.route(s, d)).select("request_id", *_r6("west", "south", "east", "north"))


@query
def request_validation(s, d):
    return checked_requests(t.request(s, d)).select(
        "request_id", "buffer_m", "max_alternatives", "mode", "use_fixture", "error"
    )


@query
def route_length(s, d):
    """Distance from the route or its legs, in km with three decimals."""
    metres = rk.route_metres(F.col("distance"), F.col("legs"))
    return t.route(s, d).select("request_id", "index", rk.kilometres(metres).alias("length_km"))


@query
def route_documents(s, d):
    """Routing answers exploded; a route without coordinates keeps its index to itself."""
    routes = explode_routes(t.route_document(s, d), "request_id").filter(F.size("vertices") > 0)
    metres = rk.route_metres(F.col("distance"), F.col("legs"))
    return routes.select(
        "request_id", "index", F.size("vertices").alias("vertices"), rk.kilometres(metres).alias("length_km")
    )


# --- crash weights and exposure ------------------------------------------------


@query
def crash_weights(s, d):
    return risk.crash_weights(t.crash(s, d), t.now()).select(
        "crash_id", "severity", "occurred_at", *_r6("lon", "lat", "sev_w", "age_months", "rec_w", "weight")
    )


@query
def severity_weights(s, d):
    """Both weight scales in their literal and corrected form."""
    severity = F.col("severity")
    return t.crash(s, d).select(
        "crash_id",
        exposure_severity_weight(severity).alias("exposure_literal"),
        exposure_severity_weight(severity, "corrected").alias("exposure_corrected"),
        score_severity_weight(severity).alias("score_literal"),
        score_severity_weight(severity, "corrected").alias("score_corrected"),
    )


@query
def route_weighted_exposure(s, d):
    """Summed crash weight inside each route's buffer."""
    requests, routes, crash = _rank_inputs(s, d)
    asked = rk.requested_routes(requests, routes)
    totals = rk.totals_per_route(asked, risk.crash_weights(crash, t.now()), ["weight"])
    return asked.select(*rk.KEY).join(totals, rk.KEY, "left").select(
        *rk.KEY, F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("exposure")
    )


@query
def severity_mix(s, d):
    return risk.severity_mix(t.crash(s, d)).select("severity", "crashes", *_r6("share"))


@query
def route_severity_mix(s, d):
    """Crashes per severity inside each route's buffer."""
    requests, routes, crash = _rank_inputs(s, d)
    asked = rk.requested_routes(requests, routes)
    names = {"fatal": 1, "serious": 2, "minor": 3}
    points = crash.select(
        "lon", "lat", *[(F.col("severity") == code).cast("bigint").alias(n) for n, code in names.items()]
    )
    return rk.totals_per_route(asked, points, list(names)).filter(
        F.col("fatal") + F.col("serious") + F.col("minor") > 0
    )


# --- tiles ---------------------------------------------------------------------


@query
def tile_coords(s, d):
    return til.tile_coords(t.crash(s, d)).select("crash_id", "x", "y")


@query
def sql_tile_coords(s, d):
    """Tiles through the table function, in SQL text."""
    return register(s).sql(
        "SELECT crash_id, t.x, t.y FROM {crash} AS c, LATERAL tile_coord(12, c.lon, c.lat) AS t", crash=t.dirty_crash(s, d)
    )


@query
def sql_crash_weights(s, d):
    """Weights through the scalar functions, in SQL text."""
    at = f"TIMESTAMP_NTZ '{t.NOW}'"
    return register(s).sql(
        "SELECT crash_id, exposure_weight(severity) AS sev_w,"
        f" round(age_in_months(occurred_at, {at}), 6) AS age_months, round(recency_weight(occurred_at, {at}), 6) AS rec_w,"
        f" round(crash_weight(severity, occurred_at, {at}), 6) AS weight FROM {{crash}}",
        crash=t.crash(s, d),
    )


@query
def sql_tile_scores(s, d):
    """How each tile ranks among all, with the score functions in SQL text."""
    tile = register(s).sql(
        "SELECT t.x, t.y, count(*) AS crashes, sum(score_weight(severity)) AS weight"
        " FROM {crash} AS c, LATERAL tile_coord(12, c.lon, c.lat) AS t GROUP BY t.x, t.y",
        crash=t.crash(s, d),
    )
    return s.sql(
        "SELECT x, y, crashes, log_score(crashes, busiest) AS score, risk_score(weight / 1000, crashes / 1000) AS risk"
        " FROM {tile}, (SELECT max(crashes) AS busiest FROM {tile})",
        tile=tile,
    )


@query
def crash_tiles(s, d):
    return til.crash_tiles(t.crash(s, d))


@query
def crash_tiles_dirty(s, d):
    """Tiles of points of which some have no tile."""
    return til.crash_tiles(t.dirty_crash(s, d))


@query
def busiest_tile_dirty(s, d):
    return til.busiest_tile(til.crash_tiles(t.dirty_crash(s, d)))


@query
def crash_tiles_z15(s, d):
    return til.crash_tiles(t.crash(s, d), zoom=15)


@query
def busiest_tile(s, d):
    return til.busiest_tile(til.crash_tiles(t.crash(s, d)))


@query
def top_tiles(s, d):
    return til.top_tiles(til.crash_tiles(t.crash(s, d)), 20)


@query
def tile_polygon(s, d):
    squares = til.with_squares(til.crash_tiles(t.crash(s, d)))
    return squares.select("x", "y", *_r6("west", "south", "east", "north"))


@query
def tile_lookup(s, d):
    return til.tile_at(til.crash_tiles(t.crash(s, d)), 853, 1554)


@query
def tile_feature_collection(s, d):
    tiles = til.tile_at(til.crash_tiles(t.crash(s, d)), 853, 1554)
    return col.single_document(til.tile_features(tiles), [F.col("x"), F.col("y")], 1)


@query
def top_tiles_feature_collection(s, d):
    top = til.top_tiles(til.crash_tiles(t.crash(s, d)), 20)
    return col.single_document(til.tile_features(top), [-F.col("crashes"), F.col("x"), F.col("y")], 20)


@query
def tile_document_parts(s, d):
    """All tiles as one document in numbered parts of 10, by the place among the busiest."""
    tiles = til.crash_tiles(t.crash(s, d)).withColumns({"whole": F.lit(1), "less": -F.col("crashes")})
    ranked = rank_in_group(tiles, ["whole"], ["less", "x", "y"], "place")
    features = til.tile_features(ranked, keep=["place"])
    return col.document_parts(features, [], "place", 10)


@query
def tile_features(s, d):
    """One Feature per tile, as lines; the ring's corners are flattened for checking."""
    tiles = til.crash_tiles(t.crash(s, d))
    ring = F.get(tile_geometry(F.col("x"), F.col("y"), 12)["coordinates"], F.lit(0))
    return tiles.select(
        "x", "y", F.size(ring).alias("corners"), ring[0][0].alias("west"), ring[0][1].alias("south"),
        ring[2][0].alias("east"), ring[2][1].alias("north"),
    )


@query
def tiles_on_route(s, d):
    requests, routes, crash = _rank_inputs(s, d)
    lines = rk.requested_routes(requests, routes).withColumn("parts", G.parts_of(F.col("vertices")))
    return til.tiles_on_lines(lines, til.crash_tiles(crash), key=rk.KEY, radius="buffer_m")


# --- risk scores ---------------------------------------------------------------

_SCORED = (
    "crashes", "crash_weight", "open_hazards", "score",
)


def _route_lines(s, d) -> DataFrame:
    return t.route(s, d).select("request_id", "index", G.parts_of(F.col("vertices")).alias("parts"))


def _scored(df: DataFrame, *key: str) -> DataFrame:
    return df.select(
        *key, F.round("length_km", 4).alias("length_km"), *_SCORED,
        *[F.round(c, 4).alias(c) for c in ("crash_cnt_per_km", "crash_weight_per_km", "hazard_per_km", "crash_points", "hazard_points")],
    )


@query
def score_routes(s, d):
    return _scored(
        risk.score_lines(_route_lines(s, d), t.crash(s, d), t.hazard(s, d), now=t.now(), key=rk.KEY), *rk.KEY
    )


@query
def score_routes_corrected(s, d):
    scored = risk.score_lines(
        _route_lines(s, d), t.crash(s, d), t.hazard(s, d), now=t.now(), key=rk.KEY, scale="corrected"
    )
    return scored.select(*rk.KEY, "crash_weight", "score")


@query
def score_wkt(s, d):
    """Scores of lines given as text."""
    texts = t.route(s, d).select("request_id", "index", G.wkt_from_vertices(F.col("vertices")).alias("wkt"))
    scored = risk.score_wkt(texts, t.crash(s, d), t.hazard(s, d), now=t.now(), key=rk.KEY, lookback_days=20, buffer_m=80.0)
    return scored.select(*rk.KEY, "crashes", "open_hazards", "score")


@query
def score_bikeways(s, d):
    return _scored(risk.score_bikeway(t.bikeway(s, d), t.crash(s, d), t.hazard(s, d), now=t.now()), "infra_id")


@query
def score_one_bikeway(s, d):
    scored = risk.score_bikeway(t.bikeway(s, d), t.crash(s, d), t.hazard(s, d), infra_id="7", now=t.now())
    return scored.select("infra_id", "crashes", "open_hazards", "score")


@query
def risk_payload(s, d):
    scored = risk.score_bikeway(t.bikeway(s, d), t.crash(s, d), t.hazard(s, d), now=t.now())
    return risk.risk_payload(scored, ["infra_id"])


@query
def risk_payload_values(s, d):
    """The texts of the payload read back: each number that they hold, rounded."""
    kind = (
        "params struct<lookback_days: int, buffer_m: double>, length_km double, counts struct<crashes: bigint, crash_weight: bigint, open_hazards: bigint>,"
        " densities struct<crash_cnt_per_km: double, crash_weight_per_km: double, hazard_per_km: double>,"
        " component_pts struct<crash_points: double, hazard_points: double>, score int"
    )
    read = risk_payload(s, d).select("infra_id", F.from_json("payload", kind).alias("p"))
    whole = read.select("infra_id", "p.length_km", "p.score", *[f"p.{c}.*" for c in ("params", "counts", "densities", "component_pts")])
    return _scored(whole, "infra_id", "lookback_days", "buffer_m")


def _near_routes(s, d, points: DataFrame, measure: str) -> DataFrame:
    """The sum within 50 m of every route, 0 where nothing is."""
    lines = _route_lines(s, d).withColumn("radius", F.lit(50.0))
    totals = totals_near_lines(
        lines, points, key=rk.KEY, radius="radius", metric="geodesic", measures=[measure], radii=[50.0]
    )
    return lines.select(*rk.KEY).join(totals, rk.KEY, "left").fillna(0, [measure])


@query
def recent_crashes_near_route(s, d):
    """Crashes of the lookback window within 50 m."""
    points = risk.recent_crashes(t.crash(s, d), t.now(), 14).select("lon", "lat", F.lit(1).cast("bigint").alias("crashes"))
    return _near_routes(s, d, points, "crashes")


@query
def open_hazards_near_route(s, d):
    points = risk.active_hazards(t.hazard(s, d), t.now(), 365).select(
        "lon", "lat", F.lit(1).cast("bigint").alias("open_hazards")
    )
    return _near_routes(s, d, points, "open_hazards")


@query
def active_hazards(s, d):
    return risk.active_hazards(t.hazard(s, d), t.now(), 365).select("hazard_id", "status", "opened_at", "closed_at")


@query
def log_score_routes(s, d):
    crash = t.crash(s, d)
    return risk.log_scores(_route_lines(s, d), crash, til.crash_tiles(crash), key=rk.KEY, buffer=BUFFER).select(
        *rk.KEY, "crashes", "score"
    )


@query
def log_score_bikeways(s, d):
    crash = t.crash(s, d)
    return risk.log_scores(t.bikeway(s, d), crash, til.crash_tiles(crash), key=["infra_id"], buffer=BUFFER).select(
        "infra_id", "crashes", "score"
    )


@query
def log_score_one_bikeway(s, d):
    """One bikeway by its key: only crashes in the box around it leave the scan."""
    crash = t.crash(s, d)
    one = t.bikeway(s, d).filter(F.col("infra_id") == "7")
    return risk.log_scores(one, crash, til.crash_tiles(crash), key=["infra_id"], buffer=BUFFER, prune=True).select(
        "infra_id", "crashes", "score"
    )


# --- loading -------------------------------------------------------------------


@query
def load_crash(s, d):
    return ingest.clean_crash(t.raw_crash(s, d), t.now()).select(
        "crash_id", "occurred_at", "severity", *_r6("lon", "lat")
    )


@query
def load_hazard(s, d):
    return ingest.clean_hazard(t.raw_hazard(s, d), t.now()).select(
        "hazard_id", "category", "status", "opened_at", "closed_at", *_r6("lon", "lat")
    )


@query
def load_bikeway(s, d):
    """Cleaned bikeways; the line as its vertex count and box."""
    df = ingest.clean_bikeway(t.raw_bikeway(s, d))
    box = G.box_of(F.flatten("parts"))
    return df.select(
        "infra_id", "class", "on_off", "status", F.size("parts").alias("parts"), F.size(F.flatten("parts")).alias("vertices"),
        *[F.round(box[k], 6).alias(k) for k in ("west", "south", "east", "north")],
    )


@query
def hazard_categories(s, d):
    """Category by keyword over whole texts."""
    return t.hazard_raw(s, d).select(
        "hazard_id", hazard_category(F.col("topic"), F.col("kind"), F.col("summary")).alias("category")
    )


@query
def hazard_statuses(s, d):
    return t.hazard_raw(s, d).select("hazard_id", hazard_status(F.col("raw_status")).alias("status"))


@query
def crash_severity(s, d):
    raw = t.raw_crash(s, d)
    return raw.select(
        F.col("_position").alias("row"),
        severity_code(lenient_int(F.col("FATALITIES")), lenient_int(F.col("SERIOUSLY_INJURED"))).alias("severity"),
    )


@query
def lenient_numbers(s, d):
    raw = t.raw_crash(s, d)
    money = F.concat(F.lit("1,"), F.lpad((F.col("_position") % 1000).cast("string"), 3, "0"))
    return raw.select(
        F.col("_position").alias("row"),
        F.round(lenient_double(F.col("geo_lon")), 6).alias("lon"),
        lenient_int(F.col("FATALITIES")).alias("fatalities"),
        lenient_int(F.col("SERIOUSLY_INJURED")).alias("injured"),
        lenient_double_with_commas(money).alias("length"),
    )


@query
def lenient_times(s, d):
    raw = t.raw_crash(s, d)
    text = F.col("first_occurrence_date")
    return raw.select(
        F.col("_position").alias("row"), utc_time(text).alias("utc"), wall_clock(text).alias("local")
    )


@query
def dedupe_first(s, d):
    """First row per repeated raw id, by position."""
    raw = t.raw_crash(s, d).select("incident_id", "_position", "geo_lat")
    return first_per_key(raw, ["incident_id"], F.col("_position")).withColumnRenamed("_position", "row")


@query
def dedupe_last(s, d):
    raw = t.raw_crash(s, d).select("incident_id", "_position", "geo_lat")
    return first_per_key(raw, ["incident_id"], F.col("_position"), last=True).withColumnRenamed("_position", "row")


_SPLIT_OLD = "2024-01-20 00:00:00"
_SPLIT_NEW = "2024-01-10 00:00:00"


def _crash_batches(s, d):
    crash = t.crash(s, d)
    new = crash.filter(F.col("occurred_at") >= F.lit(_SPLIT_NEW).cast("timestamp_ntz"))
    return (
        crash.filter(F.col("occurred_at") < F.lit(_SPLIT_OLD).cast("timestamp_ntz")),
        new.withColumn("severity", (F.lit(4) - F.col("severity")).cast("smallint")),
    )


@query
def merge_crash(s, d):
    stored, incoming = _crash_batches(s, d)
    return upsert_crash(stored, incoming).select("crash_id", "occurred_at", "severity", *_r6("lon", "lat"))


def _hazard_batches(s, d):
    hazard = t.hazard(s, d)
    early = F.lit("2023-08-01 00:00:00").cast("timestamp_ntz")
    late = F.lit("2023-05-01 00:00:00").cast("timestamp_ntz")
    stored = hazard.filter(F.col("opened_at") < early)
    incoming = hazard.filter(F.col("opened_at") >= late).withColumns(
        {
            "status": F.lit("closed"),
            "opened_at": F.when(F.col("category") != "other", F.col("opened_at")),
            "closed_at": F.when(F.col("category") == "other", t.now()),
        }
    )
    return stored, incoming


@query
def merge_hazard(s, d):
    """Overlapping hazard batches; incoming null times keep the stored ones."""
    return upsert_hazard(*_hazard_batches(s, d)).select("hazard_id", "category", "status", "opened_at", "closed_at")


@query
def merge_bikeway(s, d):
    """The raw bikeway batch laid over the stored table."""
    stored = t.bikeway(s, d)
    incoming = ingest.clean_bikeway(t.raw_bikeway(s, d))
    merged = upsert_bikeway(stored, incoming, ingest.bikeway_key(stored))
    return merged.select("infra_id", "class", "on_off", "status", F.size("parts").alias("parts"))


@query
def load_and_merge_crash(s, d):
    """A raw batch cleaned and laid over the stored crashes."""
    merged = ingest.load_crash(t.raw_crash(s, d), _crash_batches(s, d)[0], t.now())
    return merged.select("crash_id", "occurred_at", "severity", *_r6("lon", "lat"))


@query
def load_and_merge_hazard(s, d):
    """A raw batch of hazards laid over the stored ones; a stored closing time stays."""
    merged = ingest.load_hazard(t.raw_hazard(s, d), _hazard_batches(s, d)[0], t.now())
    return merged.select("hazard_id", "category", "status", "opened_at", "closed_at", *_r6("lon", "lat"))


@query
def load_and_merge_bikeway(s, d):
    """A raw batch of bikeways, reprojected, laid over the stored ones."""
    merged = ingest.load_bikeway(t.raw_bikeway(s, d), t.bikeway(s, d))
    box = G.box_of(F.flatten("parts"))
    return merged.select(
        "infra_id", "class", "on_off", "status", F.size("parts").alias("parts"), F.size(F.flatten("parts")).alias("vertices"),
        F.round(box["west"], 6).alias("west"), F.round(box["south"], 6).alias("south"),
    )


def _tile_merge(s, d):
    """Tiles of the stored crashes, and what a raw batch that moves many of them changes."""
    stored, incoming = _crash_batches(s, d)[0], ingest.clean_crash(t.raw_crash(s, d), t.now())
    return til.crash_tiles(stored), til.tile_differences(stored, incoming, ["crash_id"])


@query
def tiles_after_merge(s, d):
    """Tile counts kept up to date by differences, not counted again."""
    return til.tiles_after(*_tile_merge(s, d))


@query
def tile_changes(s, d):
    """The differences themselves."""
    return _tile_merge(s, d)[1]


@query
def busiest_tile_after_merge(s, d):
    """The highest count after a merge, from peaks by block of which only touched ones are new."""
    tiles, differences = _tile_merge(s, d)
    after = til.peaks_after(til.peaks(tiles), til.tiles_after(tiles, differences), differences)
    return til.busiest_tile(after)


@query
def incremental_load(s, d):
    """Three overlapping crash deltas over an empty base, newest per key."""
    crash = t.crash(s, d)
    day = F.dayofmonth("occurred_at")
    deltas = crash.withColumns({"batch": F.lit(0).cast("int"), "severity": F.col("severity")})
    for batch, first_day in ((1, 10), (2, 20)):
        later = crash.filter(day >= first_day).withColumns(
            {"batch": F.lit(batch).cast("int"), "severity": (F.col("severity") + batch).cast("smallint")}
        )
        deltas = deltas.unionByName(later)
    base = crash.filter(F.lit(False))
    return current_table(base, deltas, ["crash_id"]).select("crash_id", "occurred_at", "severity")


@query
def hazard_alert(s, d):
    """Open hazards near saved routes, the batch form of the alert stream."""
    key = ["user_id", "route_id"]
    return hazard_alerts(t.hazard(s, d), watch_cells(t.user_route(s, d), key), key)


@query
def hazard_digest(s, d):
    """Alerts of each saved line counted by category and week of their time, the batch form."""
    key = ["user_id", "route_id"]
    found = hazard_alerts(t.hazard(s, d), watch_cells(t.user_route(s, d), key), key)
    return hazard_digests(found, key, "7 days")


@query
def key_violation(s, d):
    """Raw ids that repeat, and raw rows without a usable longitude."""
    raw = t.raw_crash(s, d).withColumn("lon", lenient_double(F.col("geo_lon")))
    return key_violations(raw, ["incident_id"], ["lon"])


@query
def load_report(s, d):
    return risk.load_report(crash=t.crash(s, d), hazard=t.hazard(s, d), bikeway=t.bikeway(s, d))


# --- geometry ------------------------------------------------------------------


@query
def wkt_roundtrip(s, d):
    """Vertices to text and back by both parsers."""
    text = G.wkt_from_vertices(F.col("vertices"))
    df = t.route(s, d).select("request_id", "index", "vertices", text.alias("wkt"))
    return df.select(
        "request_id", "index",
        (G.vertices_from_wkt(F.col("wkt")) == F.col("vertices")).alias("strict_same"),
        (G.parts_from_wkt(F.lower("wkt")) == F.array("vertices")).alias("parts_same"),
        F.size(G.vertices_from_wkt(F.lower("wkt"))).alias("strict_lower"),
        F.size(F.split("wkt", ",")).alias("pairs"),
    )


@query
def mercator_roundtrip(s, d):
    mx, my = G.mercator_x(F.col("lon")), G.mercator_y(F.col("lat"))
    return t.crash(s, d).select(
        "crash_id", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"),
        F.round(G.lon_of(mx), 6).alias("lon"), F.round(G.lat_of(my), 6).alias("lat"),
    )


@query
def state_plane_to_wgs84(s, d):
    x = (F.lit(3140000) + (F.col("event_id") * 7919) % 10007).cast("double")
    y = (F.lit(1690000) + (F.col("event_id") * 6101) % 10009).cast("double")
    point = G.state_plane_to_lonlat(x, y)
    return t.events(s, d).select(
        "event_id", F.round(point["lon"], 7).alias("lon"), F.round(point["lat"], 7).alias("lat")
    )


@query
def geodesic_length(s, d):
    """Route lengths on the ellipsoid in metres, plain and with long segments cut."""
    parts = G.parts_of(F.col("vertices"))
    return t.route(s, d).select(
        "request_id", "index", F.round(G.geodesic_length(parts), 3).alias("metres"),
        F.round(G.geodesic_length(G.densify(parts)), 3).alias("metres_cut"),
    )


@query
def line_clean(s, d):
    """Repeated neighbouring vertices and short parts dropped."""
    v = F.col("vertices")
    doubled = F.flatten(F.transform(v, lambda p: F.array(p, p)))
    lonely = F.array(F.get(v, F.lit(0)), F.get(v, F.lit(0)))
    cleaned = G.clean_line(F.array(doubled, lonely))
    return t.route(s, d).select(
        "request_id", "index", F.size(cleaned).alias("parts"), F.size(F.flatten(cleaned)).alias("vertices"),
        (F.get(cleaned, F.lit(0)) == v).alias("same"),
    )


# --- alternatives --------------------------------------------------------------


def _primaries(s, d) -> DataFrame:
    """Each request's route of lowest index, with start and end."""
    first = t.route(s, d).groupBy("request_id").agg(F.min(F.struct("index", "vertices", "distance", "duration")).alias("p"))
    return valid_requests(t.request(s, d)).join(first.select("request_id", "p.*"), "request_id")


@query
def detour_waypoints(s, d):
    """All candidate waypoints: compass, on the line, east and west."""
    requests = valid_requests(t.request(s, d))
    sideways = requests.select("*", F.lit(0).alias("have"))
    points = (
        alt.compass_waypoints(requests)
        .unionByName(alt.on_line_waypoints(_primaries(s, d)))
        .unionByName(alt.east_west_waypoints(sideways, "have", "max_alternatives"))
    )
    return points.select("request_id", "kind", "step", *_r6("lon", "lat"))


def _candidates(s, d) -> DataFrame:
    """A candidate of some kind for every order, some of them without coordinates."""
    kind = F.when(F.col("index") % 3 == 0, "east_west").when(F.col("index") % 3 == 1, "compass").otherwise("on_line")
    none = F.array().cast(G.VERTICES_TYPE)
    return t.route(s, d).select(
        "request_id", F.col("index").alias("was"), kind.alias("kind"), (F.col("duration") * 4.4).alias("distance"),
        F.when(F.col("index") % 7 == 0, none).otherwise(F.col("vertices")).alias("vertices"),
    )


@query
def distinct_alternatives(s, d):
    return alt.distinct_enough(_candidates(s, d), _primaries(s, d)).select("request_id", "was", "kind")


@query
def more_routes(s, d):
    """Primary routes with accepted candidates appended, as many as were asked for."""
    primaries = _primaries(s, d)
    routes = primaries.select("request_id", F.col("index").alias("was"), "distance")
    extra = alt.distinct_enough(_candidates(s, d), primaries).select("request_id", "kind", "was", "distance")
    return alt.with_more_routes(valid_requests(t.request(s, d)), routes, extra, "was").select("request_id", "was", "index")


def _padded(s, d, how):
    padded = alt.pad_alternatives(valid_requests(t.request(s, d)), t.route(s, d), how)
    by_turns = F.transform("vertices", lambda v, j: F.when(j % 2 == 0, v["lat"]).otherwise(-v["lat"]))
    return padded.select(
        "request_id", "index", "is_synthetic", F.round("distance", 8).alias("distance"),
        F.round("duration", 8).alias("duration"),
        F.round(F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v["lat"]), 6).alias("lat_sum"),
        # Moves up and down by turns show in the difference of even and odd vertices.
        F.round(F.aggregate(by_turns, F.lit(0.0), lambda a, x: a + x), 6).alias("lat_by_turns"),
    )


@query
def pad_alternatives(s, d):
    return _padded(s, d, "zigzag")


@query
def pad_alternatives_shifted(s, d):
    return _padded(s, d, "shift")
