"""Lengths of lines on the ellipsoid, worked out for a batch of lines at once.

The same as ``geodesic_length(densify(parts))`` of :mod:`functions.geometry`,
which is evaluated vertex by vertex.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from kerbline.fixed_values import WGS84_A, WGS84_F
from kerbline.operators.strips import _portions, _spread
from kerbline.session import shipped

_E2 = WGS84_F * (2 - WGS84_F)
# Pieces of long segments that are worked on at a time.
PIECES = 100_000


def _step(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """``geodesic_step``: metres by the radii at the middle latitude."""
    middle = np.radians((lat1 + lat2) / 2)
    s = np.sin(middle)
    w = 1.0 - _E2 * s * s
    north = np.radians(lat2 - lat1) * (WGS84_A * (1 - _E2) / (w * np.sqrt(w)))
    east = np.radians(lon2 - lon1) * (WGS84_A / np.sqrt(w) * np.cos(middle))
    return np.sqrt(north * north + east * east)


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    p, m = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(m), np.cos(p) * np.sin(m), np.sin(p)])


def _arc(ends: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stops of segments (rows lon1, lat1, lon2, lat2) cut into so many pieces of their
    great circle, both ends as they are: ``lon``, ``lat``, the segment, and whether it is its last."""
    a, b = _unit(*ends[:2]), _unit(*ends[2:])
    angle = 2.0 * np.arcsin(np.sqrt(((b - a) ** 2).sum(0)) / 2)
    k, of = _spread(np.zeros(len(pieces), np.int64), pieces + 1)
    share = k / pieces[of]
    v = (np.sin((1.0 - share) * angle[of]) * a[:, of] + np.sin(share * angle[of]) * b[:, of]) / np.sin(angle[of])
    lon = np.degrees(np.arctan2(v[1], v[0]))
    lat = np.degrees(np.arctan2(v[2], np.sqrt(v[0] * v[0] + v[1] * v[1])))
    first, last = k == 0, k == pieces[of]
    lon, lat = (np.where(first, p[of], np.where(last, q[of], z)) for z, p, q in ((lon, ends[0], ends[2]), (lat, ends[1], ends[3])))
    return lon, lat, of, last


def stops(ends: np.ndarray, max_metres: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Segments longer than ``max_metres`` cut along their great circle, others as they are:
    the pieces, and the segment of each."""
    metres = _step(*ends)
    pieces = np.where(metres > max_metres, np.ceil(metres / max_metres), 1.0).astype(np.int64)
    long = np.flatnonzero(pieces > 1)
    if not len(long):
        return ends, np.arange(len(pieces))
    of = np.repeat(np.arange(len(pieces)), pieces)
    out = ends[:, of]
    lon, lat, _, last = _arc(ends[:, long], pieces[long])
    inner = np.flatnonzero(~last)
    cut = np.flatnonzero(pieces[of] > 1)
    out[:, cut] = np.stack([lon[inner], lat[inner], lon[inner + 1], lat[inner + 1]])
    return out, of


def _along_arc(ends: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Metres of segments in so many pieces of their great circle."""
    out = np.zeros(len(pieces))
    for i, j in _portions(pieces, PIECES):
        lon, lat, of, last = _arc(ends[:, i:j], pieces[i:j])
        inner = np.flatnonzero(~last)
        np.add.at(out, of[inner] + i, _step(lon[inner], lat[inner], lon[inner + 1], lat[inner + 1]))
    return out


def steps_of(parts: pa.Array) -> tuple[np.ndarray, ...]:
    """The first vertex and the line of each segment, and ``lon``, ``lat`` (not a number where null) and
    whether both are there for all vertices of lines (lists of lists of ``lon`` and ``lat``)."""
    of_line = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False))
    inner = parts.flatten()
    part = np.repeat(np.arange(len(inner)), pc.list_value_length(inner).fill_null(0).to_numpy(zero_copy_only=False))
    vertices = inner.flatten()
    fields = dict(zip([f.name for f in vertices.type], vertices.flatten(), strict=True))
    lon, lat = (fields[c].fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
    there = pc.and_(fields["lon"].is_valid(), fields["lat"].is_valid()).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(part[1:] == part[:-1])
    return begin, of_line[part[begin]], lon, lat, there


def line_metres(parts: pa.Array, max_metres: float = 1000.0) -> pa.Array:
    """Metres along all parts of each line; segments longer than ``max_metres`` follow their
    great circle. Null for a line that is null, or has a segment without one of its four numbers."""
    begin, line, lon, lat, there = steps_of(parts)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        ends = np.stack([lon[begin], lat[begin], lon[begin + 1], lat[begin + 1]])
        metres = _step(*ends)
        long = np.flatnonzero((metres > max_metres) & (metres < np.inf))
        metres[long] = _along_arc(ends[:, long], np.ceil(metres[long] / max_metres).astype(np.int64))
    total = np.zeros(len(parts))
    np.add.at(total, line, metres)
    unknown = parts.is_null().to_numpy(zero_copy_only=False)
    unknown[line[~(there[begin] & there[begin + 1])]] = True
    return pa.array(total, mask=unknown)


def with_metres(lines: DataFrame, parts: str = "parts", name: str = "metres") -> DataFrame:
    """The other columns of ``lines`` and the length of each line in metres; see :func:`line_metres`."""
    shipped(lines.sparkSession)
    kept = [c for c in lines.columns if c != parts]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in kept] + [line_metres(batch.column(parts))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, name])

    schema = StructType([*(lines.schema[c] for c in kept), StructField(name, DoubleType())])
    return lines.select(*kept, parts).mapInArrow(measure, schema)
