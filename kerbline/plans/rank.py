"""Ranking the route alternatives of every request in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.fixed_values import BADGES
from kerbline.functions.geojson import feature, line_geometry
from kerbline.functions.geometry import box_of, parts_of, wkt_from_vertices
from kerbline.functions.scoring import kilometres
from kerbline.operators.proximity import totals_near_lines
from kerbline.operators.requests import valid_requests
from kerbline.operators.skew import rank_in_group

KEY = ["request_id", "index"]
ORDER = ["crashes", "length_km", "index"]


def route_metres(distance: Column, legs: Column) -> Column:
    """Route length: its own distance, else the sum over its legs, else 0."""
    by_legs = F.aggregate(legs, F.lit(0.0), lambda total, leg: total + F.coalesce(leg["distance"], F.lit(0.0)))
    return F.coalesce(distance, by_legs, F.lit(0.0))


def requested_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes of the valid requests that have coordinates; indexes stay as they are."""
    asked = valid_requests(requests).select("request_id", "buffer_m", "mode")
    drawn = routes.filter(F.size("vertices") > 0)
    return drawn.join(asked, "request_id").withColumn(
        "length_km", kilometres(route_metres(F.col("distance"), F.col("legs")))
    )


def totals_per_route(asked: DataFrame, points: DataFrame, measures: list[str]) -> DataFrame:
    """Measure sums per requested route inside its buffer; lacks routes with nothing near."""
    lines = asked.select(*KEY, "buffer_m", parts_of(F.col("vertices")).alias("parts"))
    return totals_near_lines(lines, points, key=KEY, radius="buffer_m", metric="mercator", measures=measures)


def scored_routes(requests: DataFrame, routes: DataFrame, crash: DataFrame) -> DataFrame:
    """Requested routes with their crash count (all crashes, unweighted)."""
    asked = requested_routes(requests, routes)
    points = crash.select("lon", "lat", F.lit(1).cast("bigint").alias("crashes"))
    # A shuffle of narrow rows, by something the sums are not dealt by yet: what
    # samples or reads the result twice starts from here and not from the join.
    totals = totals_per_route(asked, points, ["crashes"]).repartition(F.xxhash64(*KEY))
    return asked.join(totals, KEY, "left").withColumn("crashes", F.coalesce("crashes", F.lit(0).cast("bigint")))


def rank_routes(
    requests: DataFrame, routes: DataFrame, crash: DataFrame, *, keep_vertices: bool = False
) -> DataFrame:
    """Alternatives ranked by fewest crashes, then shortest, then index."""
    scored = scored_routes(requests, routes, crash).select(
        "request_id", "mode", "index", "length_km", "crashes",
        wkt_from_vertices(F.col("vertices")).alias("wkt"), *(["vertices"] if keep_vertices else []),
    )
    first = {"winner": "index", "winner_crashes": "crashes", "winner_km": "length_km"}
    ranked = rank_in_group(scored, ["request_id"], ORDER, first=first)
    return ranked.withColumn("is_winner", F.col("rank") == 1)


def winners(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """Winner per valid request, null where no route could be ranked."""
    best = scored.groupBy("request_id").agg(
        F.min(F.struct(*ORDER)).alias("_best"), F.count("*").alias("routes")
    )
    return (
        valid_requests(requests)
        .select("request_id", "mode")
        .join(best, "request_id", "left")
        .select(
            "request_id", "mode", F.col("_best.index").alias("winner"), F.col("_best.crashes").alias("crashes"),
            F.col("_best.length_km").alias("length_km"), F.coalesce("routes", F.lit(0).cast("bigint")).alias("routes"),
        )
    )


# --- enrichment for display ---------------------------------------------------


def risk_rank(rank: Column) -> Column:
    """-1 for the winner, then 0, 1, 2, 2, ..."""
    return F.when(rank == 1, -1).otherwise(F.least(rank - 2, F.lit(2)))


def risk_class(risk: Column) -> Column:
    return F.when(risk == -1, "winner").when(risk == 0, "medium").otherwise("high")


def badge(klass: Column) -> Column:
    (first, text), *rest = BADGES.items()
    chain = F.when(klass == first, text)
    for name, label in rest:
        chain = chain.when(klass == name, label)
    return chain


def crash_text(difference: Column) -> Column:
    many = F.abs(difference)
    noun = F.when(many == 1, "crash").otherwise("crashes")
    return F.when(difference > 0, F.concat(F.lit("+"), many, F.lit(" more "), noun)).otherwise(
        F.concat(many, F.lit(" fewer "), noun)
    )


def length_text(difference: Column) -> Column:
    return F.when(difference > 0, F.format_string("+%.1f km longer", difference)).otherwise(
        F.format_string("%.1f km shorter", F.abs(difference))
    )


def enriched(ranked: DataFrame) -> DataFrame:
    """Ranked routes with risk class, badge and comparison against the winner."""
    crash_difference = F.col("crashes") - F.col("winner_crashes")
    km_difference = F.round(F.col("length_km") - F.col("winner_km"), 3)
    other = ~F.col("is_winner")
    return (
        ranked.withColumn("risk_rank", risk_rank(F.col("rank")))
        .withColumn("risk_class", risk_class(F.col("risk_rank")))
        .withColumns(
            {
                "badge": badge(F.col("risk_class")),
                "crash_difference": crash_difference,
                "km_difference": km_difference,
                "crash_text": F.when(other, crash_text(crash_difference)),
                "length_text": F.when(other, length_text(km_difference)),
            }
        )
    )


def request_summary(scored: DataFrame) -> DataFrame:
    """Number of routes and the range of their crash counts per request."""
    return scored.groupBy("request_id").agg(
        F.count("*").alias("routes"), F.min("crashes").alias("min_crashes"), F.max("crashes").alias("max_crashes")
    )


def request_boxes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Bounding box per request over its route vertices, its start and its end."""
    vertices = (
        routes.filter(F.size("vertices") > 0)
        .select("request_id", box_of(F.col("vertices")).alias("b"))
        .groupBy("request_id")
        .agg(
            F.min("b.west").alias("west"), F.min("b.south").alias("south"),
            F.max("b.east").alias("east"), F.max("b.north").alias("north"),
        )
    )
    ends = valid_requests(requests).select("request_id", "start", "end")
    start, end = F.col("start"), F.col("end")
    return vertices.join(ends, "request_id").select(
        "request_id",
        F.least("west", start[0], end[0]).alias("west"),
        F.least("south", start[1], end[1]).alias("south"),
        F.greatest("east", start[0], end[0]).alias("east"),
        F.greatest("north", start[1], end[1]).alias("north"),
    )


def route_features(ranked: DataFrame, *properties: str) -> DataFrame:
    """One GeoJSON Feature per ranked route (needs ``vertices``)."""
    names = properties or ("index", "crashes", "length_km", "is_winner")
    return ranked.select(
        "request_id", "rank",
        feature(line_geometry(F.col("vertices")), **{n: F.col(n) for n in names}).alias("feature"),
    )
