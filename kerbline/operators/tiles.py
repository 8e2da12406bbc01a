"""Point counts on Web-Mercator tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.fixed_values import CRASH_TILE_ZOOM, TILE_ORIGIN
from kerbline.functions.geojson import feature, tile_geometry
from kerbline.functions.geometry import (
    cell_id,
    mercator_x,
    mercator_y,
    tile_size,
    tile_square,
    tile_x,
    tile_y,
)
from kerbline.operators.proximity import line_cells, planar_hit


def on_the_map(lon: Column, lat: Column) -> Column:
    """Whether a point has a tile: the projection knows no other longitudes and latitudes."""
    return F.coalesce(lon.between(-180, 180) & (F.abs(lat) < 90), F.lit(False))


def tile_coords(points: DataFrame, zoom: int = CRASH_TILE_ZOOM) -> DataFrame:
    """Add tile column ``x`` and row ``y`` of each point. Points outside the
    projection (infinite, missing, beyond a pole) have no tile and are left out."""
    return points.filter(on_the_map(F.col("lon"), F.col("lat"))).withColumns(
        {
            "x": tile_x(mercator_x(F.col("lon")), zoom).cast("int"),
            "y": tile_y(mercator_y(F.col("lat")), zoom).cast("int"),
        }
    )


def crash_tiles(crash: DataFrame, zoom: int = CRASH_TILE_ZOOM) -> DataFrame:
    """Crashes per tile; counted on each task before the shuffle."""
    return tile_coords(crash, zoom).groupBy("x", "y").agg(F.count("*").alias("crashes"))


def busiest_tile(tiles: DataFrame) -> DataFrame:
    """One row: the highest count, 1 where there are no tiles."""
    return tiles.agg(F.coalesce(F.max("crashes"), F.lit(1).cast("bigint")).alias("max_tile"))


def tile_differences(stored: DataFrame, incoming: DataFrame, key: Sequence[str], zoom: int = CRASH_TILE_ZOOM) -> DataFrame:
    """How a merge of ``incoming`` into ``stored`` changes the counts of tiles: x,
    y and a signed ``change``, for tiles that change only.

    Rows that are replaced leave their tile, those of the batch enter theirs.
    Both sides are no larger than the batch, and are counted before they move;
    of the stored table only rows with a key of the batch are looked at.
    """
    replaced = stored.join(incoming.select(*key), list(key), "left_semi")
    signed = [tile_coords(df, zoom).select("x", "y", F.lit(n).cast("bigint").alias("change")) for df, n in ((replaced, -1), (incoming, 1))]
    changes = signed[0].unionByName(signed[1]).groupBy("x", "y").agg(F.sum("change").alias("change"))
    return changes.filter(F.col("change") != 0)


def tiles_after(tiles: DataFrame, differences: DataFrame) -> DataFrame:
    """Tile counts with the differences added; a tile without points goes."""
    both = tiles.select("x", "y", "crashes").unionByName(differences.select("x", "y", F.col("change").alias("crashes")))
    return both.groupBy("x", "y").agg(F.sum("crashes").alias("crashes")).filter(F.col("crashes") != 0)


#: A block of tiles is 2 to this power wide and high.
PEAK_LEVELS = 4


def _block() -> list[Column]:
    return [F.shiftright("x", PEAK_LEVELS).alias("bx"), F.shiftright("y", PEAK_LEVELS).alias("by")]


def peaks(tiles: DataFrame) -> DataFrame:
    """The highest count of each block of tiles: bx, by, ``crashes``."""
    return tiles.groupBy(*_block()).agg(F.max("crashes").alias("crashes"))


def peaks_after(before: DataFrame, tiles: DataFrame, differences: DataFrame) -> DataFrame:
    """Peaks after a merge. A count may have shrunk, so blocks with a changed tile
    are looked through again, in the new ``tiles``; the others keep their peak."""
    touched = differences.select(*_block()).distinct()
    fresh = peaks(tiles.select("x", "y", "crashes", *_block()).join(touched, ["bx", "by"], "left_semi"))
    return before.join(touched, ["bx", "by"], "left_anti").unionByName(fresh)


def with_squares(tiles: DataFrame, zoom: int = CRASH_TILE_ZOOM) -> DataFrame:
    """Add the tile edges in degrees: west, south, east, north."""
    square = tile_square(F.col("x"), F.col("y"), zoom)
    return tiles.withColumns({k: square[k] for k in ("west", "south", "east", "north")})


def tile_at(tiles: DataFrame, x: int | Column, y: int | Column) -> DataFrame:
    return tiles.filter((F.col("x") == x) & (F.col("y") == y))


def top_tiles(tiles: DataFrame, n: int) -> DataFrame:
    """The n busiest tiles; column and row break ties."""
    return tiles.orderBy(F.desc("crashes"), "x", "y").limit(n)


def tile_features(tiles: DataFrame, zoom: int = CRASH_TILE_ZOOM, keep: Sequence[str] = ()) -> DataFrame:
    """One GeoJSON Feature per tile, with the columns ``keep`` beside it."""
    return tiles.select(
        "x", "y", "crashes", *keep,
        feature(
            tile_geometry(F.col("x"), F.col("y"), zoom), x=F.col("x"), y=F.col("y"), crashes=F.col("crashes")
        ).alias("feature"),
    )


def _reaches_cell(zoom: int) -> Column:
    """Whether the segment of a line-cell row comes within its radius of the cell's square."""
    size, origin = F.lit(tile_size(zoom)), F.lit(TILE_ORIGIN)
    west = F.shiftright("cell", 32) * size - origin
    north = origin - F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)) * size
    east, south = west + size, north - size
    seg = F.col("seg")
    ax, ay, dx, dy = seg["a"], seg["b"], seg["c"], seg["d"]
    zero, one = F.lit(0.0), F.lit(1.0)

    def stretch(start: Column, run: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Shares of the segment between which one coordinate lies in the square."""
        outside = (start < low) | (start > high)
        first, second = (low - start) / run, (high - start) / run
        enter = F.when(run != 0, F.least(first, second)).when(outside, F.lit(2.0)).otherwise(zero)
        leave = F.when(run != 0, F.greatest(first, second)).when(outside, F.lit(-1.0)).otherwise(one)
        return enter, leave

    x_in, x_out = stretch(ax, dx, west, east)
    y_in, y_out = stretch(ay, dy, south, north)
    crosses = F.greatest(x_in, y_in, zero) <= F.least(x_out, y_out, one)

    def end_gap(x: Column, y: Column) -> Column:
        east_gap = F.greatest(west - x, zero, x - east)
        north_gap = F.greatest(south - y, zero, y - north)
        return east_gap * east_gap + north_gap * north_gap

    reach = F.col("radius") * F.col("radius")
    near = crosses | (end_gap(ax, ay) <= reach) | (end_gap(ax + dx, ay + dy) <= reach)
    for x, y in ((west, south), (west, north), (east, north), (east, south)):
        near = near | planar_hit(seg, x, y, reach)
    return near


def tiles_on_lines(
    lines: DataFrame,
    tiles: DataFrame,
    *,
    key: Sequence[str],
    radius: str,
    parts: str = "parts",
    zoom: int = CRASH_TILE_ZOOM,
) -> DataFrame:
    """Tiles a line's buffer touches, with the summed crashes.

    Lines move once by key: neither the distinct nor the sums shuffle again
    while the tiles fit a broadcast. Every crash tile is one row, so the hot side
    of a shuffled join is the lines, which the engine's skew handling cuts.
    """
    key = list(key)
    listed = line_cells(lines.select(*key, parts, radius).repartition(*key), key, parts, radius, "mercator", zoom)
    touched = listed.filter(_reaches_cell(zoom)).select(*key, "cell").distinct()
    by_cell = tiles.select(cell_id(F.col("x"), F.col("y")).alias("cell"), "crashes")
    return (
        touched.join(by_cell, "cell")
        .groupBy(*key)
        .agg(F.count("*").alias("tiles"), F.sum("crashes").alias("crashes"))
    )
