"""Candidate detours and stand-in copies when a request has too few routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.fixed_values import (
    COMPASS_DEGREES,
    COMPASS_MIN_DIFFERENCE,
    EAST_WEST_DEGREES,
    ON_LINE_FALLBACK_DEGREES,
    ON_LINE_MIN_DIFFERENCE,
    ON_LINE_SHIFT,
    SHIFT_DEGREES,
    SHIFT_STRETCH,
    ZIGZAG_DEGREES,
    ZIGZAG_STRETCH,
)
from kerbline.functions.geometry import vertex
from kerbline.functions.scoring import relative_difference
from kerbline.operators.skew import rank_in_group


def _waypoint(kind: str, order: Column, lon: Column, lat: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), order.cast("int").alias("step"), lon.alias("lon"), lat.alias("lat")
    )


def _middle() -> tuple[Column, Column]:
    start, end = F.col("start"), F.col("end")
    return (start[0] + end[0]) / 2, (start[1] + end[1]) / 2


def compass_waypoints(requests: DataFrame) -> DataFrame:
    """North, south, east and west of the middle between start and end."""
    lon, lat = _middle()
    d, none = F.lit(COMPASS_DEGREES), F.lit(0.0)
    moves = ((none, d), (none, -d), (d, none), (-d, none))
    points = F.array(*[_waypoint("compass", F.lit(i), lon + dx, lat + dy) for i, (dx, dy) in enumerate(moves)])
    return requests.select("request_id", F.inline(points))


def on_line_waypoints(primaries: DataFrame) -> DataFrame:
    """Points at one and two thirds of the primary route, pushed sideways.

    Needs ``request_id``, ``start``, ``end`` and the primary's ``vertices``. A
    primary of at most two vertices uses the middle, moved north and south.
    """
    start, end, vertices = F.col("start"), F.col("end"), F.col("vertices")
    n = F.coalesce(F.size(vertices), F.lit(0))
    lon, lat = _middle()
    bare = n <= 2
    d = F.lit(ON_LINE_FALLBACK_DEGREES)
    push_lat = (end[0] - start[0]) * F.lit(-ON_LINE_SHIFT)
    push_lon = (end[1] - start[1]) * F.lit(ON_LINE_SHIFT)
    points = []
    for i, sign in enumerate((1, -1)):
        at = F.get(vertices, F.floor(F.lit(i + 1) * n / F.lit(3)).cast("int"))
        base_lon = F.when(bare, lon).otherwise(at["lon"])
        base_lat = F.when(bare, lat + sign * d).otherwise(at["lat"])
        points.append(_waypoint("on_line", F.lit(i), base_lon + sign * push_lon, base_lat + sign * push_lat))
    return primaries.select("request_id", F.inline(F.array(*points)))


def east_west_waypoints(requests: DataFrame, have: str, needed: str) -> DataFrame:
    """From ``have`` up to ``needed`` points, alternately east and west of the middle, each further out."""
    lon, lat = _middle()
    steps = F.when(
        F.col(needed) > F.col(have), F.sequence(F.col(have).cast("int"), (F.col(needed) - 1).cast("int"))
    ).otherwise(F.array().cast("array<int>"))

    def point(k: Column) -> Column:
        reach = F.lit(EAST_WEST_DEGREES) * (k + 1)
        return _waypoint("east_west", k, F.when(k % 2 == 0, lon + reach).otherwise(lon - reach), lat)

    return requests.select("request_id", F.inline(F.transform(steps, point)))


# Kinds of candidates in the order in which they are asked for.
KINDS = ("compass", "on_line", "east_west")


def distinct_enough(candidates: DataFrame, primaries: DataFrame) -> DataFrame:
    """Candidate routes with coordinates whose length differs enough from their
    request's primary.

    ``candidates``: ``request_id``, ``kind``, ``vertices``, ``distance`` and
    whatever else; ``primaries`` is unique on ``request_id`` with ``vertices`` and
    ``distance``. Compass candidates need a primary with coordinates as well.
    East/west candidates are taken whatever their length; a kind without a rule
    is refused.
    """
    drawn = F.coalesce(F.size("vertices"), F.lit(0)) > 0
    base = primaries.select("request_id", F.coalesce("distance", F.lit(0.0)).alias("_primary"), drawn.alias("_drawn"))
    joined = candidates.filter(drawn).join(base, "request_id").filter((F.col("kind") != "compass") | F.col("_drawn"))
    difference = relative_difference(F.coalesce("distance", F.lit(0.0)), F.col("_primary"))
    least = F.when(F.col("kind") == "compass", F.lit(COMPASS_MIN_DIFFERENCE)).when(
        F.col("kind") == "on_line", F.lit(ON_LINE_MIN_DIFFERENCE)
    )
    return joined.filter((F.col("kind") == "east_west") | (difference > least)).drop("_primary", "_drawn")


def with_more_routes(
    requests: DataFrame, routes: DataFrame, extra: DataFrame, order: str, most: int | None = None
) -> DataFrame:
    """Routes followed by extra ones, numbered anew from 0 within each request.

    Extra routes (``kind``, ``order``) come in the order in which kinds are asked
    for, and only until the request has its ``max_alternatives``, or ``most`` if
    that is less. Routes that are there already all stay.
    """
    kinds = F.when(F.col("kind") == KINDS[0], 1).when(F.col("kind") == KINDS[1], 2).otherwise(3)
    both = routes.withColumn("_from", F.lit(0)).unionByName(extra.withColumn("_from", kinds).drop("kind"), allowMissingColumns=True)
    numbered = rank_in_group(both, ["request_id"], ["_from", order], rank="_n")
    wanted = F.least(F.col("max_alternatives"), F.lit(most)) if most is not None else F.col("max_alternatives")
    asked = requests.select("request_id", wanted.alias("_wanted"))
    return (
        numbered.join(asked, "request_id")
        .filter((F.col("_from") == 0) | (F.col("_n") <= F.col("_wanted")))
        .withColumn("index", (F.col("_n") - 1).cast("int"))
        .drop("_n", "_from", "_wanted")
    )


def _copies(primaries: DataFrame, count: Column, moved, stretch: tuple[float, float]) -> DataFrame:
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    drawn = primaries.filter(F.size("vertices") > 0)
    first, more = stretch
    factor = F.lit(first) + F.col("copy") * F.lit(more)
    return drawn.withColumn("copy", F.explode(steps)).withColumns(
        {
            "vertices": F.transform("vertices", lambda v, j: moved(v, j, F.col("copy"))),
            "distance": F.col("distance") * factor,
            "duration": F.col("duration") * factor,
            "is_synthetic": F.lit(True),
        }
    )


def zigzag_copies(primaries: DataFrame, count: Column) -> DataFrame:
    """Copies of a route whose vertices jump north and south by turns."""

    def moved(v, j, copy):
        reach = F.lit(ZIGZAG_DEGREES) * (copy + 1)
        return vertex(v["lon"], F.when(j % 2 == 0, v["lat"] + reach).otherwise(v["lat"] - reach))

    return _copies(primaries, count, moved, ZIGZAG_STRETCH)


def shifted_copies(primaries: DataFrame, count: Column) -> DataFrame:
    """Copies of a route moved as a whole, north and south by turns."""

    def moved(v, _j, copy):
        reach = F.lit(SHIFT_DEGREES) * (copy + 1)
        return vertex(v["lon"], F.when(copy % 2 == 0, v["lat"] + reach).otherwise(v["lat"] - reach))

    return _copies(primaries, count, moved, SHIFT_STRETCH)


def pad_alternatives(
    requests: DataFrame, routes: DataFrame, how: str = "zigzag"
) -> DataFrame:
    """Fill each request up to ``max_alternatives`` with invented copies.

    Off unless called: the copies are not roads anybody can travel, and carry
    ``is_synthetic``. Requests without a single route stay empty, requests with
    enough routes keep all of them.
    """
    make = {"zigzag": zigzag_copies, "shift": shifted_copies}[how]
    columns = ["request_id", "index", "vertices", "distance", "duration", "legs"]
    real = routes.select(*columns).withColumn("is_synthetic", F.lit(False))
    have = routes.groupBy("request_id").agg(
        F.count("*").alias("_have"), F.max("index").alias("_last"),
        F.min(F.struct("index", *columns[2:])).alias("_primary"),
    )
    asked = requests.select("request_id", "max_alternatives")
    short = have.join(asked, "request_id").filter(F.col("_have") < F.col("max_alternatives"))
    primaries = short.select("request_id", "_have", "max_alternatives", "_last",
                             *[F.col(f"_primary.{c}").alias(c) for c in columns[2:]])
    missing = (F.col("max_alternatives") - F.col("_have")).cast("int")
    copies = make(primaries, missing).withColumn("index", (F.col("_last") + 1 + F.col("copy")).cast("int"))
    return real.unionByName(copies.select(*real.columns))
