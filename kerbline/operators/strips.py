"""Sums over the points near each line, for rows that come sorted by block.

A task sees one block of the plane after the other: its points, then the lines
that reach it. The points lie in strips of about equal latitude, sorted by
longitude, with running sums. In a strip the buffer of a segment is an interval:
what is surely inside is one difference of running sums, and only points near
the edge are tested one by one. So the work per line grows with the root of the
points in its buffer and not with their number.

Distances are those of :mod:`operators.proximity`: both metrics scale a point's
distances east and north (``kx``, ``ky``; 1 in the plane), by its latitude alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Height of a strip in mean distances between points, and strips of a block at most.
HEIGHT, MOST_STRIPS = 1.5, 4096
# Width of a column in mean distances between points, and columns per point at most.
COLUMN, COLUMNS = 0.5, 4.0
# Rows of lines, segments in strips, and single tests that are worked on at a time;
# small arrays are reused by the allocator, large ones cost a page fault each 4 KB.
LINE_ROWS, INTERVALS, TESTS = 10_000, 24_000, 24_000
_TINY = 1e-9
# This near to the end or the edge of a segment's buffer, as a share of it, the exact test decides.
EDGE = 1e-4


def _reach(v: np.ndarray, c: np.ndarray, d: np.ndarray, r: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the buffer of the segment (0, 0)-(c, d) goes to one side at the
    height ``v``, and whether it gets there."""
    steep = np.where(np.abs(d) < _TINY, _TINY, d)
    length = np.maximum(np.hypot(c, d), _TINY)
    low, high = (v - r) / steep, (v + r) / steep
    low, high = np.maximum(np.minimum(low, high), 0.0), np.minimum(np.maximum(low, high), 1.0)
    along = (v + side * np.sign(steep) * c * r / length) / steep
    along = np.minimum(np.maximum(along, low), high)
    rise = v - along * steep
    return along * c + side * np.sqrt(np.maximum(r * r - rise * rise, 0.0)), (low <= high) & (r > 0)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last), and the range of each."""
    size = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size - first)[of], of


def _portions(size: np.ndarray, most: int, starts: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of some ``most`` in all, cut only at ``starts`` if given."""
    if not len(size):
        return
    number = (np.cumsum(size) - size) // most
    if starts is not None:
        number = number[starts]
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    cuts = cuts if starts is None else starts[cuts]
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)], strict=True)


class Strips:
    """The points of a block in strips, each cut into columns."""

    def __init__(self, x, y, kx, ky, values: Sequence[np.ndarray], planar: bool):
        self.planar, n = planar, len(x)
        self.west, self.south = x.min(), y.min()
        width, height = x.max() - self.west, y.max() - self.south
        # The smallest scale is that of the whole block.
        self.least_kx, self.least_ky = (1.0, 1.0) if planar else (float(kx.min()), float(ky.min()))
        across = 1.0 if planar else float(kx.max())
        self.slack = 1e-5 + 1e-11 * (width * across + height * self.least_ky)
        apart = np.sqrt(width * across * height * self.least_ky / n)
        thick = max(HEIGHT * apart / self.least_ky, height / MOST_STRIPS)
        strip = np.floor((y - self.south) / thick).astype(np.int64) if thick > 0 else np.zeros(n, np.int64)
        there = np.bincount(strip) > 0
        strip = (np.cumsum(there) - 1)[strip]
        self.width, strips = width, int(there.sum())
        self.columns = int(max(1, min(width * across / (COLUMN * apart) if apart > 0 else 1, COLUMNS * n / strips)))
        self.per_x = self.columns / width if width > 0 else 0.0
        cell = strip * self.columns + self._column(x)
        order = np.argsort(cell, kind="stable")
        #: The first point of each column of each strip; a strip's end is the next one's start.
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=strips * self.columns))]).astype(np.int32 if n < 1 << 31 else np.int64)
        strip, self.x, self.y = strip[order], x[order], y[order]
        self.east, self.north = self.x - self.west, self.y - self.south
        begin = np.flatnonzero(np.concatenate([[True], strip[1:] != strip[:-1]]))
        self.low, self.high = np.minimum.reduceat(self.y, begin), np.maximum.reduceat(self.y, begin)
        self.uneven = 0.0  # how much scales differ within a strip
        if planar:
            self.kx = self.ky = None
        else:
            self.kx, self.ky = kx[order], ky[order]
            self.scales = [f.reduceat(k, begin) for f in (np.minimum, np.maximum) for k in (self.kx, self.ky)]
            self.uneven = float(max((self.scales[2] / self.scales[0]).max(), (self.scales[3] / self.scales[1]).max()) - 1)
        self.edge = max(EDGE, 64 * self.uneven)
        # A value that all points share is not summed, but counted.
        self.same = [v[0] if np.isfinite(v[0]) and (v == v[0]).all() else None for v in values]
        self.kinds = [np.longdouble if v.dtype.kind == "f" else np.int64 for v in values]
        self.values = [v[order] if c is None else None for v, c in zip(values, self.same, strict=True)]
        self.sums = [None if v is None else np.concatenate([[0], np.cumsum(v, dtype=k)]) for v, k in zip(self.values, self.kinds, strict=True)]
        # Sums that are not finite can't be told by differences; then all is tested.
        self.summable = all(s is None or np.isfinite(s[-1]) for s in self.sums)
        if not self.summable:
            self.sums = [None if s is None else np.zeros_like(s) for s in self.sums]

    def _column(self, x: np.ndarray) -> np.ndarray:
        """Columns grow with x and go from -1, west of all, to one past the last."""
        share = np.minimum(np.maximum((x - self.west) * self.per_x, -1.0), float(self.columns))
        inside = (x >= self.west) & (x <= self.west + self.width)
        column = np.floor(share).astype(np.int64)
        return np.where(inside, np.minimum(column, self.columns - 1), np.where(x < self.west, -1, self.columns))

    def _first(self, strip: np.ndarray, x: np.ndarray, past: int) -> np.ndarray:
        """The first point of the column that ``x`` lies in, or of the one after it."""
        column = np.minimum(np.maximum(self._column(x) + past, 0), self.columns)
        return self.starts[strip * self.columns + column].astype(np.int64)

    def _intervals(self, strip, a, b, c, d, r):
        """First and last point of each strip that may lie near, and that surely do."""
        def scaled(which: int):
            if self.planar:
                return 1.0, 1.0, c, d
            kx, ky = self.scales[2 * which][strip], self.scales[2 * which + 1][strip]
            return kx, ky, c * kx, d * ky

        low, high = self.low[strip] - b, self.high[strip] - b
        kx, ky, sc, sd = scaled(0)
        wide = r * (1 + 1e-6) + self.slack
        bottom, top = np.minimum(low * ky, high * ky), np.maximum(low * ky, high * ky)
        east = np.minimum(np.maximum(np.where(sc > 0, sd, 0.0), bottom), top)
        west = np.minimum(np.maximum(np.where(sc > 0, 0.0, sd), bottom), top)
        right, there = _reach(east, sc, sd, wide, 1)
        left, _ = _reach(west, sc, sd, wide, -1)
        p0 = self._first(strip, a + left / kx, 0)
        p1 = np.where(there, self._first(strip, a + right / kx, 1), p0)
        p1 = np.maximum(p1, p0)
        kx, ky, sc, sd = scaled(1)
        narrow = r * (1 - 1e-6) - self.slack
        right, there = _reach(low * ky, sc, sd, narrow, 1)
        left, _ = _reach(low * ky, sc, sd, narrow, -1)
        right_too, there_too = _reach(high * ky, sc, sd, narrow, 1)
        left_too, _ = _reach(high * ky, sc, sd, narrow, -1)
        left, right = np.maximum(left, left_too), np.minimum(right, right_too)
        sure = there & there_too & (left < right) & self.summable
        d0 = np.minimum(np.maximum(self._first(strip, a + left / kx, 1), p0), p1)
        d1 = np.minimum(np.maximum(self._first(strip, a + right / kx, 0), d0), p1)
        return p0, p1, np.where(sure, d0, p0), np.where(sure, d1, p0)

    def _hits(self, point, a, b, c, d, r) -> np.ndarray:
        """The distance test of :mod:`operators.proximity`, operation by operation."""
        u, v = self.x[point] - a, self.y[point] - b
        if not self.planar:
            kx, ky = self.kx[point], self.ky[point]
            u, v, c, d = u * kx, v * ky, c * kx, d * ky
        along, squared, reach = u * c + v * d, c * c + d * d, r * r
        across = u * d - v * c
        hit = across * across <= reach * squared
        # Before the start, or past the end.
        end = np.flatnonzero(along >= squared)
        x, y = u[end] - c[end], v[end] - d[end]
        hit[end] = x * x + y * y <= reach[end]
        end = np.flatnonzero(along <= 0)
        x, y = u[end], v[end]
        hit[end] = x * x + y * y <= reach[end]
        return hit

    def _ruler(self, strip, a, b, c, d, r) -> np.ndarray:
        """Where a place stands beside a segment (-1 to 1 in reach of its line) and
        along it (0 to 1), as two linear forms of its ``east`` and ``north``. Not
        a number where the scales of a strip don't tell it well enough."""
        kx, ky = (1.0, 1.0) if self.planar else (self.scales[0][strip], self.scales[1][strip])
        a, b, c, d = (a - self.west) * kx, (b - self.south) * ky, c * kx, d * ky
        squared = c * c + d * d
        length = np.sqrt(squared)
        ruler = np.stack([d * kx, c * ky, a * d - b * c, c * kx, d * ky, a * c + b * d])
        ruler[:3] /= length * r
        ruler[3:] /= squared
        ruler[:, ~((np.minimum(length, r) > 1e3 * self.slack) & (8 * self.uneven * (length + r) < self.edge * length))] = np.nan
        return ruler

    def _near(self, point, at, piece, ruler, segments, segment) -> np.ndarray:
        """Whether each point is near the segment of its piece (number ``at`` of
        ``piece``). Beside a segment's middle its line decides; only at its ends, and
        where rounding might, does the test itself."""
        east, north = self.east[point], self.north[point]
        p, q, o, s, t, u = ruler.take(piece[at], axis=1)
        beside = np.abs(east * p - north * q - o)
        along = east * s + north * t - u
        hit = (beside < 1 - self.edge) & (along > self.edge) & (along < 1 - self.edge)
        # Also what is not a number.
        open_ = np.flatnonzero(~((beside > 1 + self.edge) | hit))
        hit[open_] = self._hits(point[open_], *segments.take(segment[piece[at[open_]]], axis=1))
        return hit

    def totals(self, line: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Number of points and sum of each value near each line; ``line`` counts up
        from 0, ``segments`` holds rows a, b, c, d, radius. A point near several
        segments of a line counts once."""
        lines = int(line[-1]) + 1
        count, sums = np.zeros(lines, np.int64), [np.zeros(lines, k) for k in self.kinds]
        a, b, c, d, r = segments
        # The stretch of the segment that can reach the block from west or east.
        room = (r * (1 + 1e-6) + self.slack) / self.least_kx
        level = np.where(np.abs(c) < 1e-300, 1e-300, c)
        enter, leave = (self.west - room - a) / level, (self.west + self.width + room - a) / level
        enter, leave = np.minimum(np.maximum(np.stack([np.minimum(enter, leave), np.maximum(enter, leave)]), 0.0), 1.0)
        room = (r * (1 + 1e-6) + self.slack) / self.least_ky
        first = np.searchsorted(self.high, b + np.minimum(enter * d, leave * d) - room, "left")
        last = np.searchsorted(self.low, b + np.maximum(enter * d, leave * d) + room, "right")
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        with np.errstate(divide="ignore", invalid="ignore"):
            for i, j in _portions(np.maximum(last - first, 0), INTERVALS, starts):
                strip, segment = _spread(first[i:j], last[i:j])
                if len(strip):
                    self._add(count, sums, line, segments, strip, segment + i)
        for total, same in zip(sums, self.same, strict=True):
            if same is not None:
                total += count * same
        return count, sums

    def _add(self, count, sums, line, segments, strip, segment) -> None:
        p0, p1, d0, d1 = self._intervals(strip, *segments.take(segment, axis=1))
        kept = np.flatnonzero(p1 > p0)
        p0, p1, d0, d1, segment, strip = (z[kept] for z in (p0, p1, d0, d1, segment, strip))
        ruler = self._ruler(strip, *segments.take(segment, axis=1))
        # Numbers of (line, point) pairs.
        own = line[segment]
        base = own * (len(self.x) + 1)
        order = np.argsort(base + p0, kind="stable")
        first, last = (base + p0)[order], (base + p1)[order]
        apart = np.zeros(len(order), bool)
        apart[1:] = first[1:] < np.maximum.accumulate(last)[:-1]
        apart[:-1] |= first[1:] < last[:-1]
        over = np.empty(len(order), bool)
        over[order] = apart
        summed = [k for k, v in enumerate(self.values) if v is not None]

        single = np.flatnonzero(~over)
        s, e = d0[single], d1[single]
        np.add.at(count, own[single], e - s)
        for k in summed:
            np.add.at(sums[k], own[single], self.sums[k][e] - self.sums[k][s])
        for point, at, begin, piece in self._edges(p0, p1, d0, d1, single):
            hit = self._near(point, at, piece, ruler, segments, segment)
            of = own[piece[at[begin]]]
            np.add.at(count, of, np.add.reduceat(hit, begin, dtype=np.int64))
            for k in summed:
                np.add.at(sums[k], of, np.add.reduceat(np.where(hit, self.values[k][point], 0), begin))
        # Intervals of one line that overlap count as their union.
        over = np.flatnonzero(over)
        if not len(over):
            return
        several = over[d1[over] > d0[over]]
        several = several[np.argsort((base + d0)[several], kind="stable")]
        s, e = (base + d0)[several], (base + d1)[several]
        s[1:] = np.maximum(s[1:], np.maximum.accumulate(e)[:-1])
        new = e > s
        s, e, off, of = s[new], e[new], base[several][new], own[several][new]
        np.add.at(count, of, e - s)
        for k in summed:
            np.add.at(sums[k], of, self.sums[k][e - off] - self.sums[k][s - off])
        pairs = [np.zeros(0, np.int64)]
        for point, at, _, piece in self._edges(p0, p1, d0, d1, over):
            hit = np.flatnonzero(self._near(point, at, piece, ruler, segments, segment))
            pairs.append(base[piece[at[hit]]] + point[hit])
        pairs = np.sort(np.concatenate(pairs))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        if len(s):
            before = np.searchsorted(s, pairs, "right") - 1
            pairs = pairs[(before < 0) | (pairs >= e[before])]
        of, point = np.divmod(pairs, len(self.x) + 1)
        np.add.at(count, of, 1)
        for k in summed:
            np.add.at(sums[k], of, self.values[k][point])

    @staticmethod
    def _edges(p0, p1, d0, d1, which: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The points of some intervals that may or may not be near, a portion at a
        time: points, the number of each one's piece, where pieces begin, and the
        interval of each piece."""
        lo, hi = np.concatenate([p0[which], d1[which]]), np.concatenate([d0[which], p1[which]])
        some = np.flatnonzero(hi > lo)
        lo, hi, piece = lo[some], hi[some], np.concatenate([which, which])[some]
        for i, j in _portions(hi - lo, TESTS):
            point, at = _spread(lo[i:j], hi[i:j])
            yield point, at + i, np.concatenate([[0], np.cumsum(hi[i:j] - lo[i:j])[:-1]]), piece


def near_totals(key: Sequence[str], measures: Sequence[str], planar: bool, schema: pa.Schema) -> Callable:
    """For ``mapInArrow``: one row per block and line with points near it.

    Rows are sorted by ``_block``, ``radius`` and key. Points come first, without a
    radius: place in ``_a``, ``_b``, scales in ``_c``, ``_d`` (not in the plane), and the measures. Rows
    of lines have their vertices in ``_line`` (:mod:`operators.blocks`).
    """
    from kerbline.operators.blocks import segments_of

    def numbers(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)

    def strips(parts: list[pa.RecordBatch]) -> Strips:
        rows = pa.Table.from_batches(parts)
        values = []
        for m in measures:
            column = rows.column(m).combine_chunks()
            # Whether there is a value at all is summed as well.
            values += [column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)]
        kx, ky = (None, None) if planar else (numbers(rows, "_c"), numbers(rows, "_d"))
        return Strips(numbers(rows, "_a"), numbers(rows, "_b"), kx, ky, values, planar)

    def lines(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for c in ["radius", *key]:
            column = rows.column(c).combine_chunks()
            if pa.types.is_floating(column.type) and c != "radius":
                column = column.dictionary_encode("encode").indices
            before, after = column.slice(0, rows.num_rows - 1), column.slice(1)
            other = pc.not_equal(before, after).fill_null(False)
            if column.null_count:
                other = pc.or_(other, pc.xor(before.is_null(), after.is_null()))
            change[1:] |= other.to_numpy(zero_copy_only=False)
        return rows, np.flatnonzero(change)

    def near(points: Strips, rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        line = np.repeat(np.arange(len(starts)), np.diff([*starts, rows.num_rows]))
        row, segments = segments_of(rows.column("_line").combine_chunks(), planar)
        count, sums = points.totals(line[row], np.concatenate([segments, numbers(rows, "radius")[None, row]]))
        found = np.flatnonzero(count)
        keys = [rows.column(k).combine_chunks().take(pa.array(starts[found])) for k in key]
        totals = [
            pa.array(sums[2 * i][found].astype("float64" if sums[2 * i].dtype.kind == "f" else "int64"), mask=sums[2 * i + 1][found] == 0)
            for i in range(len(measures))
        ]
        yield pa.RecordBatch.from_arrays([*keys, *totals], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, points, placed, held = None, [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("_block").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                if blocks[i] != block:
                    if held:
                        yield from near(placed, *lines(held))
                    block, points, placed, held = blocks[i], [], None, []
                many = batch.column("radius").slice(i, j - i).null_count
                if many:
                    points.append(batch.slice(i, many))
                if many == j - i or not points and placed is None:
                    continue
                if placed is None:
                    placed, points = strips(points), []
                held.append(batch.slice(i + many, j - i - many))
                if sum(h.num_rows for h in held) >= LINE_ROWS:
                    rows, starts = lines(held)
                    # The last line may go on in the next batch.
                    if len(starts) > 1:
                        yield from near(placed, rows.slice(0, starts[-1]), starts[:-1])
                        rows = rows.take(pa.array(np.arange(starts[-1], rows.num_rows)))
                    held = rows.combine_chunks().to_batches()
        if held:
            yield from near(placed, *lines(held))

    return run
