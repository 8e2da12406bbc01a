"""Points near lines, by grid cells.

Every point lies in exactly one cell. Every line lists the cells its buffer
can touch, so on a cell a (line, point) pair meets at most once and no distinct
is needed. Sums per line go by large cells, blocks, whose points are kept in
order (:mod:`operators.strips`); matches themselves are an equi-join on small
cells with the exact distance test as its residual condition.

Two metrics: ``mercator`` measures in Web-Mercator units, ``geodesic`` in
metres on the ellipsoid (local radii at the point, long segments cut along
their great circle first).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from kerbline.fixed_values import TILE_ORIGIN, TILE_WORLD
from kerbline.functions.geometry import (
    along_arc,
    arc_angle,
    cell_id,
    mercator_x,
    mercator_y,
    metres_per_radian_east,
    metres_per_radian_north,
    piece_count,
    steps,
    tile_size,
    unit_vector,
    vertex_of_vector,
)
from kerbline.operators.blocks import line_rows
from kerbline.operators.strips import near_totals
from kerbline.session import shipped

# The finest grid; a cell measures some 153 units there.
CELL_ZOOM = 18
# A cell is at least this share of the radius, so that a buffer touches few of them.
CELL_SHARE = 3.0
# Segments of a (line, cell) row kept in plain columns, before an array of the rest.
# More would grow the generated join method past what the JVM compiles.
INLINE_SEGMENTS = 2
# Blocks of points are this many zooms coarser than the finest cells.
BLOCK_STEPS = 4
# The lines of a block go to this many tasks.
LINE_SHARES = 4
# Room for rounding in the cell bounds, in Mercator units.
_SLACK = 1e-3


def zoom_of(radius: float, finest: int = CELL_ZOOM) -> int:
    """The zoom whose cells suit a radius."""
    if not 0 < radius < math.inf:
        return finest
    return min(finest, max(0, math.floor(math.log2(TILE_WORLD * CELL_SHARE / radius))))


def _zoom_column(radius: Column, finest: int) -> Column:
    fitting = F.floor(F.log2(F.lit(TILE_WORLD * CELL_SHARE) / radius)).cast("int")
    return F.when((radius > 0) & (radius < math.inf), F.least(F.lit(finest), F.greatest(F.lit(0), fitting))).otherwise(finest)


def _size(zoom: int | Column) -> Column:
    return F.lit(tile_size(zoom)) if isinstance(zoom, int) else F.lit(TILE_WORLD) / F.pow(F.lit(2.0), zoom)


def _column_of(mx: Column, zoom: int | Column) -> Column:
    """Column of the grid; what lies outside belongs to the border."""
    return _inside(F.floor((mx + F.lit(TILE_ORIGIN)) / _size(zoom)), zoom)


def _row_of(my: Column, zoom: int | Column) -> Column:
    return _inside(F.floor((F.lit(TILE_ORIGIN) - my) / _size(zoom)), zoom)


def _inside(number: Column, zoom: int | Column) -> Column:
    most = F.lit(2**zoom - 1) if isinstance(zoom, int) else F.pow(F.lit(2.0), zoom) - 1
    return F.least(F.greatest(number.cast("bigint"), F.lit(0).cast("bigint")), most.cast("bigint"))


def _cell(column: Column, row: Column, zoom: Column) -> Column:
    """Cells of all zooms in one number."""
    return cell_id(zoom.cast("bigint") * F.lit(1 << 24) + column, row)


def line_cells(
    lines: DataFrame, key: Sequence[str], parts: str, radius: str, metric: str, zoom: int | str = CELL_ZOOM
) -> DataFrame:
    """One row per line, segment and touched cell: key, ``radius``, ``cell``, ``seg``.

    ``zoom`` is a number, or a column with the zoom of each line; then ``cell``
    holds the zoom as well. Segments with a missing or infinite end touch none.

    ``seg`` is the segment as the distance test wants it: start (a, b) and
    vector (c, d), in Mercator units or, for the geodesic metric, radians.
    """
    _check_metric(metric)
    # A planar buffer of width zero is empty; a geodesic distance of zero is a touch.
    wide_enough = F.col(radius) > 0 if metric == "mercator" else F.col(radius) >= 0
    mixed = isinstance(zoom, str)
    carry = [*key, "radius", *([zoom] if mixed else [])]
    ends = ["_lon1", "_lat1", "_lon2", "_lat2"]
    segments = (
        lines.filter(wide_enough)
        .select(*key, F.col(radius).alias("radius"), *([zoom] if mixed else []), F.explode(F.flatten(F.transform(parts, steps))).alias("_s"))
        .select(
            *carry, F.col("_s.a.lon").alias("_lon1"), F.col("_s.a.lat").alias("_lat1"),
            F.col("_s.b.lon").alias("_lon2"), F.col("_s.b.lat").alias("_lat2"),
        )
        .filter(reduce(lambda a, b: a & b, [F.abs(c) < math.inf for c in ends]))
    )
    if metric == "geodesic":
        segments = _short_pieces(segments, carry)
    segments = segments.select(
        *carry, *ends,
        mercator_x(F.col("_lon1")).alias("_x1"), mercator_y(F.col("_lat1")).alias("_y1"),
        mercator_x(F.col("_lon2")).alias("_x2"), mercator_y(F.col("_lat2")).alias("_y2"),
    )
    x1, y1, x2, y2 = (F.col(c) for c in ("_x1", "_y1", "_x2", "_y2"))
    if metric == "mercator":
        grow = F.col("radius") + F.lit(_SLACK)
        dx, dy = x2 - x1, y2 - y1
        seg = F.struct(x1.alias("a"), y1.alias("b"), dx.alias("c"), dy.alias("d"))
    else:
        # Mercator units per metre grow with latitude; one per cent covers the
        # ellipsoid, and the reach itself is added to the latitude.
        farthest = F.radians(F.greatest(F.abs("_lat1"), F.abs("_lat2"))) + F.col("radius") / F.lit(6.3e6)
        grow = F.col("radius") / F.cos(F.least(farthest, F.lit(1.57))) * F.lit(1.01) + F.lit(1.0)
        seg = F.struct(
            F.radians("_lon1").alias("a"), F.radians("_lat1").alias("b"),
            F.radians(F.col("_lon2") - F.col("_lon1")).alias("c"), F.radians(F.col("_lat2") - F.col("_lat1")).alias("d"),
        )
    at = F.col(zoom) if mixed else zoom
    size = _size(at)
    origin = F.lit(TILE_ORIGIN)
    rows = segments.select(
        *carry, seg.alias("seg"), grow.alias("_grow"), "_x1", "_y1", "_x2", "_y2"
    ).select(
        "*",
        F.explode(
            F.sequence(
                _row_of(F.greatest("_y1", "_y2") + F.col("_grow"), at),
                _row_of(F.least("_y1", "_y2") - F.col("_grow"), at),
            )
        ).alias("_cy"),
    )
    # The stretch of the segment that can reach this row of cells.
    top = origin - F.col("_cy") * size + F.col("_grow")
    bottom = origin - (F.col("_cy") + 1) * size - F.col("_grow")
    rise = F.col("_y2") - F.col("_y1")
    run = F.col("_x2") - F.col("_x1")
    at_top, at_bottom = (top - F.col("_y1")) / rise, (bottom - F.col("_y1")) / rise
    flat = F.abs(rise) < F.lit(1e-9)
    zero, one = F.lit(0.0), F.lit(1.0)
    enter = F.when(flat, zero).otherwise(F.least(F.greatest(F.least(at_top, at_bottom), zero), one))
    leave = F.when(flat, one).otherwise(F.least(F.greatest(F.greatest(at_top, at_bottom), zero), one))
    xa, xb = F.col("_x1") + enter * run, F.col("_x1") + leave * run
    cell = _cell(F.col("_cx"), F.col("_cy"), F.col(zoom)) if mixed else cell_id(F.col("_cx"), F.col("_cy"))
    return rows.select(
        *carry, "seg", "_cy",
        F.explode(
            F.sequence(_column_of(F.least(xa, xb) - F.col("_grow"), at), _column_of(F.greatest(xa, xb) + F.col("_grow"), at))
        ).alias("_cx"),
    ).select(*key, "radius", "seg", cell.alias("cell"))


def _short_pieces(segments: DataFrame, carry: Sequence[str], max_metres: float = 1000.0) -> DataFrame:
    """Segments longer than ``max_metres`` cut along their great circle; others as they are."""
    ends = ["_lon1", "_lat1", "_lon2", "_lat2"]
    cut = (
        segments.select(*carry, *ends, piece_count(*[F.col(c) for c in ends], max_metres).alias("_n"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
        .select(
            "*", unit_vector(F.col("_lon1"), F.col("_lat1")).alias("_va"), unit_vector(F.col("_lon2"), F.col("_lat2")).alias("_vb")
        )
        .select("*", arc_angle(F.col("_va"), F.col("_vb")).alias("_w"))
    )

    def stop(k: Column) -> Column:
        return along_arc(F.col("_va"), F.col("_vb"), F.col("_w"), k / F.col("_n"))

    first, last = F.col("_k") == 0, F.col("_k") == F.col("_n") - 1
    stops = cut.select(
        *carry, *ends, first.alias("_first"), last.alias("_last"),
        F.when(~first, stop(F.col("_k"))).alias("_p"), F.when(~last, stop(F.col("_k") + 1)).alias("_q"),
    )
    p, q = vertex_of_vector(F.col("_p")), vertex_of_vector(F.col("_q"))
    return stops.select(
        *carry,
        F.when(F.col("_first"), F.col("_lon1")).otherwise(p["lon"]).alias("_lon1"),
        F.when(F.col("_first"), F.col("_lat1")).otherwise(p["lat"]).alias("_lat1"),
        F.when(F.col("_last"), F.col("_lon2")).otherwise(q["lon"]).alias("_lon2"),
        F.when(F.col("_last"), F.col("_lat2")).otherwise(q["lat"]).alias("_lat2"),
    )


def _check_metric(metric: str) -> None:
    if metric not in ("mercator", "geodesic"):
        raise ValueError(f"metric must be mercator or geodesic, not {metric}")


def _within(u: Column, v: Column, c: Column, d: Column, squared_reach: Column) -> Column:
    """Whether the point at (u, v) from a segment's start is near the segment (c, d).

    Free of divisions: before the start, past the end, or beside the segment.
    """
    along, squared = u * c + v * d, c * c + d * d
    across = u * d - v * c
    return (
        F.when(along <= 0, u * u + v * v <= squared_reach)
        .when(along >= squared, (u - c) * (u - c) + (v - d) * (v - d) <= squared_reach)
        .otherwise(across * across <= squared_reach * squared)
    )


def planar_hit(seg, x: Column, y: Column, squared_reach: Column) -> Column:
    """The distance test in Mercator units."""
    return _within(x - seg["a"], y - seg["b"], seg["c"], seg["d"], squared_reach)


def _tangent_hit(seg, x: Column, y: Column, kx: Column, ky: Column, squared_reach: Column) -> Column:
    """The same test in metres, on the tangent plane at the point."""
    return _within((x - seg["a"]) * kx, (y - seg["b"]) * ky, seg["c"] * kx, seg["d"] * ky, squared_reach)


def _any_segment(hit) -> Column:
    """Whether any segment of a grouped row is a hit.

    The first few lie in plain columns, so that the common short groups never
    leave generated code; longer groups go on with the rest of the array.
    """
    tests = [
        (F.col("seg_count") > i) & hit({c: F.col(f"_{c}{i}") for c in "abcd"}) for i in range(INLINE_SEGMENTS)
    ]
    rest = (F.col("seg_count") > INLINE_SEGMENTS) & F.exists("more_segs", hit)
    return reduce(lambda a, b: a | b, [*tests, rest])


def _point_cells(points: DataFrame, measures: Sequence[str], metric: str, zoom: int | Column, combine: bool) -> DataFrame:
    """Points with their cell; points at one place become one row first.

    ``zoom`` is a number, or an array of all zooms in use: then a point has a
    cell in each of them, and cells hold their zoom.
    """
    located = points.select("lon", "lat", *measures)
    if combine:
        located = located.groupBy("lon", "lat").agg(*[F.sum(m).alias(m) for m in measures])
    at = zoom
    if not isinstance(zoom, int):
        located, at = located.withColumn("_zoom", F.explode(zoom)), F.col("_zoom")
    mx, my = mercator_x(F.col("lon")), mercator_y(F.col("lat"))
    column, row = _column_of(mx, at), _row_of(my, at)
    cell = (cell_id(column, row) if isinstance(zoom, int) else _cell(column, row, at)).alias("cell")
    if metric == "mercator":
        return located.select(cell, mx.alias("px"), my.alias("py"), *measures)
    return located.select(
        cell,
        F.radians("lon").alias("px"),
        F.radians("lat").alias("py"),
        metres_per_radian_east(F.col("lat")).alias("kx"),
        metres_per_radian_north(F.col("lat")).alias("ky"),
        *measures,
    )


def totals_near_lines(
    lines: DataFrame,
    points: DataFrame,
    *,
    key: Sequence[str],
    radius: str,
    metric: str,
    measures: Sequence[str],
    parts: str = "parts",
    zoom: int = CELL_ZOOM,
    radii: Sequence[float] | None = None,
    combine: bool = True,
) -> DataFrame:
    """Sum point measures over the points within ``radius`` of each line.

    ``points`` has ``lon``, ``lat`` and numeric ``measures``. Lines without a hit
    are absent from the result. A radius above 0 has blocks to suit it, some
    2,400 units wide at the finest for the default ``zoom``; a caller who knows
    all radii states them in ``radii`` and saves a look at the column.
    ``combine`` says whether points at one place are summed before they move,
    which is a shuffle of its own; a caller who has few points left does without.

    One plan for all sizes, with one shuffle: lines go to the few blocks that
    their buffer touches, one row in each (:mod:`operators.blocks`), and points to
    the block they lie in. Cells are never
    written out, and few pairs are looked at (:mod:`operators.strips`). The lines of
    a block are dealt into shares, each of which gets the points of the block.
    """
    _check_metric(metric)
    shipped(lines.sparkSession)
    key, measures = list(key), list(measures)
    finest = max(0, zoom - BLOCK_STEPS)
    fitted = _zoom_column(F.col(radius), finest)
    if radii is None:
        zooms = lines.agg(F.collect_set(fitted)).scalar()
    else:
        zooms = F.array(*[F.lit(z) for z in sorted({zoom_of(r, finest) for r in radii})])
    placed = _point_cells(points, measures, metric, zooms, combine)
    shaped = lines.select(
        *key, parts, F.col(radius).cast("double").alias("radius"), fitted.alias("_zoom"), F.pmod(F.xxhash64(*key), F.lit(LINE_SHARES)).alias("_share")
    )
    kinds = dict(placed.dtypes)
    kinds = {m: "double" if kinds[m] in ("float", "double") else "bigint" for m in measures}
    types = {f.name: f.dataType for f in shaped.select(*key).schema}
    laid = StructType(
        [StructField("_block", LongType()), StructField("radius", DoubleType()), *[StructField(c, types[c]) for c in key], StructField("_line", BinaryType())]
    )
    segments = shaped.mapInArrow(line_rows(key, parts, metric == "mercator", to_arrow_schema(laid)), laid)

    def none(name: str, kind) -> Column:
        return F.lit(None).cast(kind).alias(name)

    block = F.col("cell").bitwiseOR(F.shiftleft(F.col("_share").cast("bigint"), 26)).alias("_block")
    scales = [F.col(c).alias(d) for c, d in (("kx", "_c"), ("ky", "_d"))] if metric == "geodesic" else []
    rows = (
        placed.filter((F.abs("px") < math.inf) & (F.abs("py") < math.inf) & F.col("cell").isNotNull())
        .select("*", F.explode(F.array(*[F.lit(i) for i in range(LINE_SHARES)])).alias("_share"))
        .select(
            block, none("radius", "double"), *[none(c, types[c]) for c in key], none("_line", "binary"),
            F.col("px").alias("_a"), F.col("py").alias("_b"), *scales, *[F.col(m).cast(kinds[m]).alias(m) for m in measures],
        )
    )
    rows = rows.unionByName(segments, allowMissingColumns=True)
    schema = StructType([StructField(c, types[c]) for c in key] + [StructField(m, DoubleType() if k == "double" else LongType()) for m, k in kinds.items()])
    near = rows.repartition("_block").sortWithinPartitions("_block", "radius", *key).mapInArrow(
        near_totals(key, measures, metric == "mercator", to_arrow_schema(schema)), schema
    )
    return near.groupBy(*key).agg(*[F.sum(m).alias(m) for m in measures])


def grouped_cells(cells: DataFrame, key: Sequence[str], on: Sequence[str] = ("cell",)) -> DataFrame:
    """One row per line and cell, with the segments of that one line that touch it."""
    flat = [
        F.get("_segs", F.lit(i))[c].alias(f"_{c}{i}") for i in range(INLINE_SEGMENTS) for c in "abcd"
    ]
    more = F.when(
        F.size("_segs") > INLINE_SEGMENTS,
        F.slice("_segs", F.lit(INLINE_SEGMENTS + 1), F.greatest(F.size("_segs") - INLINE_SEGMENTS, F.lit(0))),
    )
    return (
        cells.groupBy(*key, "radius", *on)
        .agg(F.collect_list("seg").alias("_segs"))
        .select(*key, "radius", *on, F.size("_segs").alias("seg_count"), *flat, more.alias("more_segs"))
    )


def near_grouped_cells(
    grouped: DataFrame, points: DataFrame, key: Sequence[str], keep: Sequence[str], metric: str, zoom: int = CELL_ZOOM
) -> DataFrame:
    """The matching (line, point) rows themselves, for results that are pairs by nature.

    Cells outgrow the engine's guess, which goes by the bytes of the lines alone
    (a line has some hundred cells), so neither side is left to be broadcast.
    """
    placed = _point_cells(points, keep, metric, zoom, combine=False)
    return placed.join(grouped.hint("merge"), "cell").filter(_near(metric)).select(*key, *keep)


def _near(metric: str) -> Column:
    """The exact distance test on a joined row."""
    squared_reach = F.col("radius") * F.col("radius")
    x, y = F.col("px"), F.col("py")

    def hit(seg) -> Column:
        if metric == "mercator":
            return planar_hit(seg, x, y, squared_reach)
        return _tangent_hit(seg, x, y, F.col("kx"), F.col("ky"), squared_reach)

    return _any_segment(hit)
