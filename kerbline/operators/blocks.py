"""Lines laid out over the blocks of a grid, a batch of lines at a time.

The blocks of a segment are those that :func:`operators.proximity.line_cells`
lists. What a line has in a block becomes one row: the vertices of its segments
there, end to end, so that neighbours share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kerbline.fixed_values import MERCATOR_RADIUS, TILE_ORIGIN, TILE_WORLD
from kerbline.operators.lengths import steps_of, stops
from kerbline.operators.strips import _portions, _spread

# Vertices that are laid out at a time.
VERTICES = 100_000
# Room for rounding in the bounds of blocks, in Mercator units.
SLACK = 1e-3
_GAP = np.full(2, np.nan)


def _mercator(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rise = np.tan(np.pi / 4 + np.radians(lat) / 2)
    return np.radians(lon) * MERCATOR_RADIUS, np.log(np.where(rise > 0, rise, np.nan)) * MERCATOR_RADIUS


def _number(share: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of a row or column; what lies outside belongs to the border."""
    return np.minimum(np.maximum(np.floor(share), 0.0), most).astype(np.int64)


def _blocks(x1, y1, x2, y2, grow, zoom) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that the buffer of each segment can touch, row by row, and the segment of each."""
    size, most = TILE_WORLD / np.exp2(zoom), np.exp2(zoom) - 1
    first = _number((TILE_ORIGIN - (np.maximum(y1, y2) + grow)) / size, most)
    last = _number((TILE_ORIGIN - (np.minimum(y1, y2) - grow)) / size, most)
    row, of = _spread(first, last + 1)
    x1, y1, run, rise, grow, size, most = (z[of] for z in (x1, y1, x2 - x1, y2 - y1, grow, size, most))
    # The stretch of the segment that can reach this row of blocks.
    flat = np.abs(rise) < 1e-9
    level = np.where(flat, 1.0, rise)
    at = np.stack([(TILE_ORIGIN - row * size + grow - y1) / level, (TILE_ORIGIN - (row + 1) * size - grow - y1) / level])
    enter, leave = np.minimum(np.maximum(np.stack([at.min(0), at.max(0)]), 0.0), 1.0)
    xa, xb = x1 + np.where(flat, 0.0, enter) * run, x1 + np.where(flat, 1.0, leave) * run
    first = _number((np.minimum(xa, xb) - grow + TILE_ORIGIN) / size, most)
    last = _number((np.maximum(xa, xb) + grow + TILE_ORIGIN) / size, most)
    column, again = _spread(first, last + 1)
    of = of[again]
    return ((zoom[of].astype(np.int64) << 24) + column) << 32 | row[again], of


def laid_out(parts: pa.Array, radius: np.ndarray, zoom: np.ndarray, planar: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The line and the block of each row, and its vertices (pairs of doubles, Mercator units
    or degrees, with a pair that is not a number between stretches).

    Segments without two finite ends touch nothing, nor does a line of which a part is null.
    """
    begin, line, lon, lat, _ = steps_of(parts)
    broken = np.zeros(len(parts), bool)
    owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False))
    broken[owner[parts.flatten().is_null().to_numpy(zero_copy_only=False)]] = True
    ends = np.stack([lon[begin], lat[begin], lon[begin + 1], lat[begin + 1]])
    # A planar buffer of width zero is empty; a geodesic distance of zero is a touch.
    wide = (radius > 0) if planar else (radius >= 0)
    fine = np.flatnonzero(np.isfinite(ends).all(0) & (wide & ~broken)[line])
    ends, line = ends[:, fine], line[fine]
    if planar:
        x1, y1 = _mercator(*ends[:2])
        x2, y2 = _mercator(*ends[2:])
        ends = np.stack([x1, y1, x2, y2])
        fine = np.flatnonzero(np.isfinite(ends).all(0))
        ends, line = ends[:, fine], line[fine]
        x1, y1, x2, y2 = ends
        grow = radius[line] + SLACK
    else:
        ends, of = stops(ends)
        line = line[of]
        x1, y1 = _mercator(*ends[:2])
        x2, y2 = _mercator(*ends[2:])
        # An end beyond a pole stands far outside.
        y1, y2 = (np.where(np.isnan(y), np.where(np.isnan(o), np.nan, np.sign(l) * 2 * TILE_ORIGIN), y) for y, o, l in ((y1, y2, ends[1]), (y2, y1, ends[3])))
        # Mercator units per metre grow with latitude; one per cent covers the
        # ellipsoid, and the reach itself is added to the latitude.
        r = radius[line]
        farthest = np.radians(np.maximum(np.abs(ends[1]), np.abs(ends[3]))) + r / 6.3e6
        grow = r / np.cos(np.minimum(farthest, 1.57)) * 1.01 + 1.0
        fine = np.flatnonzero(np.isfinite(y1) & np.isfinite(y2))
        ends, line, grow, x1, y1, x2, y2 = ends[:, fine], line[fine], grow[fine], x1[fine], y1[fine], x2[fine], y2[fine]
    block, of = _blocks(x1, y1, x2, y2, grow, zoom[line].astype(np.float64))
    order = np.lexsort([of, block, line[of]])
    block, of = block[order], of[order]
    own = line[of]
    new = np.ones(len(of), bool)
    new[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
    # Whether a segment goes on where the one before it in the row ends.
    on = np.zeros(len(of), bool)
    on[1:] = ~new[1:] & (of[1:] == of[:-1] + 1)
    on[1:] &= (ends[:2, of[1:]] == ends[2:, of[:-1]]).all(0)
    size = np.where(new, 2, np.where(on, 1, 3))
    last = np.cumsum(size) - 1
    out = np.empty((int(size.sum()), 2))
    out[last] = ends[2:, of].T
    out[last[~on] - 1] = ends[:2, of[~on]].T
    out[last[size == 3] - 2] = _GAP
    head = np.flatnonzero(new)
    offsets = np.append(last[head] - 1, len(out)) * 16
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return own[head], block[head], rows


def segments_of(rows: pa.Array, planar: bool) -> tuple[np.ndarray, np.ndarray]:
    """The segments of rows that :func:`laid_out` made: the row of each, and start (a, b) and
    vector (c, d) in Mercator units or radians."""
    rows = rows.cast(pa.large_binary())
    at = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, rows.offset * 8)
    place = np.frombuffer(rows.buffers()[2], np.float64, (at[-1] - at[0]) // 8, at[0]).reshape(-1, 2).T
    row = np.repeat(np.arange(len(rows)), np.diff(at) // 16)
    there = ~np.isnan(place[0])
    k = np.flatnonzero((row[1:] == row[:-1]) & there[1:] & there[:-1])
    start, vector = place[:, k], place[:, k + 1] - place[:, k]
    if not planar:
        start, vector = np.radians(start), np.radians(vector)
    return row[k], np.concatenate([start, vector])


def line_rows(key: Sequence[str], parts: str, planar: bool, schema: pa.Schema) -> Callable:
    """For ``mapInArrow``: lines (key, parts, ``radius``, ``_zoom``, ``_share``) to rows of
    ``_block``, ``radius``, key and ``_line``."""
    binary = schema.field("_line").type

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            vertices = pc.list_value_length(whole.column(parts)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = whole.column(parts).flatten()
            owner = np.repeat(np.arange(whole.num_rows), vertices)
            np.add.at(vertices, owner, pc.list_value_length(inner).fill_null(0).to_numpy(zero_copy_only=False))
            for i, j in _portions(vertices + 1, VERTICES):
                batch = whole.slice(i, j - i)
                radius = batch.column("radius").fill_null(np.nan).to_numpy(zero_copy_only=False)
                zoom = batch.column("_zoom").fill_null(0).to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    line, block, rows = laid_out(batch.column(parts), radius, zoom, planar)
                share = batch.column("_share").to_numpy(zero_copy_only=False).astype(np.int64)
                own = pa.array(line)
                columns = [pa.array(block | share[line] << 26), pa.array(radius[line]), *(batch.column(k).take(own) for k in key), rows.cast(binary)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
