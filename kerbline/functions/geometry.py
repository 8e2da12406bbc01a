"""Points, lines and tiles as plain columns.

Conventions: ``lon``/``lat`` are WGS84 degrees, ``mx``/``my`` Web-Mercator
units. A line is ``parts``, an ``array<array<struct<lon,lat>>>``; a single
linestring is one part. Nothing here is a UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.fixed_values import (
    GRS80_F,
    MERCATOR_RADIUS,
    STATE_PLANE_2232,
    TILE_ORIGIN,
    TILE_WORLD,
    WGS84_A,
    WGS84_F,
)
from kerbline.functions.parsing import let, strip

LINE_TYPE = "array<array<struct<lon:double,lat:double>>>"
VERTICES_TYPE = "array<struct<lon:double,lat:double>>"

# --- Web Mercator ------------------------------------------------------------


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(MERCATOR_RADIUS)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(MERCATOR_RADIUS)


def lon_of(mx: Column) -> Column:
    return F.degrees(mx / F.lit(MERCATOR_RADIUS))


def lat_of(my: Column) -> Column:
    return F.degrees(F.atan(F.sinh(my / F.lit(MERCATOR_RADIUS))))


def tile_size(zoom: int) -> float:
    return TILE_WORLD / 2**zoom


def tile_x(mx: Column, zoom: int) -> Column:
    return F.floor((mx + F.lit(TILE_ORIGIN)) / F.lit(tile_size(zoom))).cast("bigint")


def tile_y(my: Column, zoom: int) -> Column:
    """Tile row; rows count southward."""
    return F.floor((F.lit(TILE_ORIGIN) - my) / F.lit(tile_size(zoom))).cast("bigint")


def cell_id(x: Column, y: Column) -> Column:
    """Tile column and row packed into one bigint."""
    return F.shiftleft(x.cast("bigint"), 32).bitwiseOR(y.cast("bigint"))


def tile_square(x: Column, y: Column, zoom: int) -> Column:
    """West, south, east, north edge of a tile in degrees."""
    size = F.lit(tile_size(zoom))
    origin = F.lit(TILE_ORIGIN)
    return F.struct(
        lon_of(x * size - origin).alias("west"),
        lat_of(origin - (y + 1) * size).alias("south"),
        lon_of((x + 1) * size - origin).alias("east"),
        lat_of(origin - y * size).alias("north"),
    )


# --- ellipsoid ---------------------------------------------------------------

_E2 = WGS84_F * (2 - WGS84_F)


def metres_per_radian_north(lat: Column) -> Column:
    """Meridian radius of curvature."""
    s = F.sin(F.radians(lat))
    return F.lit(WGS84_A * (1 - _E2)) / F.pow(F.lit(1.0) - F.lit(_E2) * s * s, F.lit(1.5))


def metres_per_radian_east(lat: Column) -> Column:
    """Length of one radian of longitude along the parallel."""
    s = F.sin(F.radians(lat))
    return F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(_E2) * s * s) * F.cos(F.radians(lat))


def geodesic_step(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two near points, by the radii at their middle latitude."""
    middle = (lat1 + lat2) / 2
    north = F.radians(lat2 - lat1) * metres_per_radian_north(middle)
    east = F.radians(lon2 - lon1) * metres_per_radian_east(middle)
    return F.sqrt(north * north + east * east)


# --- lines -------------------------------------------------------------------


def vertex(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def vertices_of(coordinates: Column) -> Column:
    """``array<array<double>>`` pairs to vertices."""
    return F.transform(coordinates, lambda c: vertex(c[0], c[1]))


def parts_of(vertices: Column) -> Column:
    return F.array(vertices)


def coordinates_of(vertices: Column) -> Column:
    return F.transform(vertices, lambda v: F.array(v["lon"], v["lat"]))


def steps(items: Column) -> Column:
    """Neighbouring pairs of an array as ``struct<a,b>``."""
    n = F.size(items)
    head = F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(items, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def clean_line(parts: Column) -> Column:
    """Drop repeated neighbouring vertices and parts left with fewer than two."""

    def distinct_run(part: Column) -> Column:
        return F.filter(part, lambda v, i: (i == 0) | (v != F.get(part, i - 1)))

    return F.filter(F.transform(parts, distinct_run), lambda p: F.size(p) >= 2)


def unit_vector(lon: Column, lat: Column) -> Column:
    p, m = F.radians(lat), F.radians(lon)
    return F.struct(
        (F.cos(p) * F.cos(m)).alias("x"), (F.cos(p) * F.sin(m)).alias("y"), F.sin(p).alias("z")
    )


def arc_angle(a: Column, b: Column) -> Column:
    """Angle between two unit vectors."""
    dx, dy, dz = (b[c] - a[c] for c in "xyz")
    return F.lit(2.0) * F.asin(F.sqrt(dx * dx + dy * dy + dz * dz) / 2)


def arc_weights(angle: Column, share: Column) -> tuple[Column, Column]:
    """How much of either end is in the vector at a share of the way (not for a zero angle)."""
    return F.sin((F.lit(1.0) - share) * angle) / F.sin(angle), F.sin(share * angle) / F.sin(angle)


def weighted(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return F.struct(*[(wa * a[c] + wb * b[c]).alias(c) for c in "xyz"])


def along_arc(a: Column, b: Column, angle: Column, share: Column) -> Column:
    """Vector at a share of the way between two unit vectors (not for a zero angle)."""
    return weighted(a, b, *arc_weights(angle, share))


def vertex_of_vector(v: Column) -> Column:
    return vertex(
        F.degrees(F.atan2(v["y"], v["x"])),
        F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))),
    )


def piece_count(lon1: Column, lat1: Column, lon2: Column, lat2: Column, max_metres: float) -> Column:
    return _pieces(geodesic_step(lon1, lat1, lon2, lat2), max_metres)


def _pieces(metres: Column, max_metres: float) -> Column:
    return F.greatest(F.ceil(metres / F.lit(max_metres)).cast("int"), F.lit(1))


def densify(parts: Column, max_metres: float = 1000.0) -> Column:
    """Cut every segment longer than ``max_metres`` along its great circle.

    Vertices of shorter segments are kept bit for bit.
    """

    # Interpreted, so what is used more than once is bound.
    def cut(step: Column) -> Column:
        a, b = step["a"], step["b"]

        def inner(metres: Column) -> Column:
            ends = F.struct(
                unit_vector(a["lon"], a["lat"]).alias("a"),
                unit_vector(b["lon"], b["lat"]).alias("b"),
                _pieces(metres, max_metres).alias("n"),
            )
            with_angle = let(ends, lambda e: F.struct(e["a"], e["b"], e["n"], arc_angle(e["a"], e["b"]).alias("w")))

            def stop(r: Column, k: Column) -> Column:
                wa, wb = arc_weights(r["w"], k / r["n"])
                shares = F.struct(wa.alias("a"), wb.alias("b"))
                return let(let(shares, lambda w: weighted(r["a"], r["b"], w["a"], w["b"])), vertex_of_vector)

            return let(
                with_angle, lambda r: F.transform(F.sequence(F.lit(1), r["n"] - 1), lambda k: stop(r, k))
            )

        one = F.array(a)
        metres = geodesic_step(a["lon"], a["lat"], b["lon"], b["lat"])
        return let(metres, lambda m: F.when(m > max_metres, F.concat(one, inner(m))).otherwise(one))

    def cut_part(part: Column) -> Column:
        return F.concat(F.flatten(F.transform(steps(part), cut)), F.slice(part, F.lit(-1), F.lit(1)))

    return F.transform(F.filter(parts, lambda p: F.size(p) >= 1), cut_part)


def geodesic_length(parts: Column) -> Column:
    """Metres along all parts. Densify first when segments can be long."""

    def add(total: Column, step: Column) -> Column:
        a, b = step["a"], step["b"]
        return total + geodesic_step(a["lon"], a["lat"], b["lon"], b["lat"])

    return F.aggregate(F.flatten(F.transform(parts, steps)), F.lit(0.0), add)


def box_of(vertices: Column) -> Column:
    """West, south, east, north of a vertex array."""
    lons = F.transform(vertices, lambda v: v["lon"])
    lats = F.transform(vertices, lambda v: v["lat"])
    return F.struct(
        F.array_min(lons).alias("west"),
        F.array_min(lats).alias("south"),
        F.array_max(lons).alias("east"),
        F.array_max(lats).alias("north"),
    )


# --- well-known text ---------------------------------------------------------

# Fixed value: what the strict parser takes, on one line.
_STRICT_LINE = r"^\s*LINESTRING\s*\((.+)\)\s*$"
_LINE = r"(?is)^\s*LINESTRING\s*(?:Z|M|ZM)?\s*\(([^()a-df-z]+)\)\s*$"
_MULTILINE = r"(?is)^\s*MULTILINESTRING\s*(?:Z|M|ZM)?\s*\(\s*\(([^a-df-z]+)\)\s*\)\s*$"


def _pairs(body: Column, separator: str) -> Column:
    """Vertex per comma-separated entry, null where it lacks two numbers."""

    def of_numbers(numbers: Column) -> Column:
        point = vertex(F.get(numbers, F.lit(0)).try_cast("double"), F.get(numbers, F.lit(1)).try_cast("double"))
        return let(point, lambda v: F.when(v["lon"].isNotNull() & v["lat"].isNotNull(), v))

    return F.transform(
        F.split(body, ","), lambda text: let(F.filter(F.split(strip(text), separator), lambda p: p != ""), of_numbers)
    )


def vertices_from_wkt(wkt: Column) -> Column:
    """Small strict parser: upper-case LINESTRING only, entries without two
    numbers skipped, anything else gives an empty array."""
    body = F.regexp_extract(wkt, _STRICT_LINE, 1)
    return F.when(body != "", F.filter(_pairs(body, " "), lambda v: v.isNotNull())).otherwise(
        F.array().cast(VERTICES_TYPE)
    )


def parts_from_wkt(wkt: Column) -> Column:
    """LINESTRING or MULTILINESTRING in any case; malformed text gives null."""
    many = F.split(F.regexp_extract(wkt, _MULTILINE, 1), r"\)\s*,\s*\(")
    one = F.array(F.regexp_extract(wkt, _LINE, 1))
    bodies = F.when(wkt.rlike(_MULTILINE), many).when(wkt.rlike(_LINE), one)
    # A text is split by one character, and empty ones are dropped: a pattern would be compiled anew for each vertex.
    parts = F.transform(bodies, lambda b: _pairs(F.translate(b, "\t\n\x0b\f\r", " " * 5), " "))

    def unless_broken(found: Column) -> Column:
        return F.when(~F.exists(found, lambda p: F.exists(p, lambda v: v.isNull())), found)

    return let(parts, unless_broken)


def wkt_from_vertices(vertices: Column) -> Column:
    pairs = F.transform(vertices, lambda v: F.concat_ws(" ", v["lon"].cast("string"), v["lat"].cast("string")))
    return F.concat(F.lit("LINESTRING("), F.array_join(pairs, ","), F.lit(")"))


# --- state plane -------------------------------------------------------------


def _conic_constants(p: dict, e: float) -> tuple[float, float, float]:
    """Cone constant, scaled radius factor and radius at the origin latitude."""

    def m(lat):
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat):
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    lat1, lat2, lat0 = (math.radians(p[k]) for k in ("lat_1", "lat_2", "lat_0"))
    n = (math.log(m(lat1)) - math.log(m(lat2))) / (math.log(t(lat1)) - math.log(t(lat2)))
    factor = m(lat1) / (n * t(lat1) ** n)
    return n, factor, WGS84_A * factor * t(lat0) ** n


def state_plane_to_lonlat(x: Column, y: Column, plane: dict = STATE_PLANE_2232) -> Column:
    """Inverse Lambert conformal conic: feet east and north to a vertex in degrees.

    The datum shift is taken as zero. Five fixed steps for the latitude leave
    an error far below a millimetre.
    """
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)
    n, factor, rho0 = _conic_constants(plane, e)
    east = (x - F.lit(plane["false_easting"])) * F.lit(plane["foot"])
    north = F.lit(rho0) - (y - F.lit(plane["false_northing"])) * F.lit(plane["foot"])
    rho = F.sqrt(east * east + north * north)
    t = F.pow(rho / F.lit(WGS84_A * factor), F.lit(1.0 / n))
    lon = F.atan2(east, north) / F.lit(n) + F.lit(math.radians(plane["lon_0"]))

    def improve(lat: Column, _step: Column) -> Column:
        s = F.lit(e) * F.sin(lat)
        return F.lit(math.pi / 2) - F.lit(2.0) * F.atan(t * F.pow((F.lit(1.0) - s) / (F.lit(1.0) + s), F.lit(e / 2)))

    start = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(t)
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, improve)
    return vertex(F.degrees(lon), F.degrees(lat))


def to_wgs84(parts: Column, srid: int) -> Column:
    """Parts in a known source system to WGS84; 4326 is the identity."""
    if srid == 4326:
        return parts
    if srid == 2232:
        return F.transform(parts, lambda p: F.transform(p, lambda v: state_plane_to_lonlat(v["lon"], v["lat"])))
    raise ValueError(f"unsupported source SRID {srid}; known: 2232, 4326")
