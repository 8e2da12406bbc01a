"""Whole Arrow batches of texts as flat arrays, for work inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in portions of about so many bytes, whatever the rows.
PORTION = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _table(name: str, n: int) -> np.ndarray:
    """Fixed random 64-bit numbers that every task computes alike."""
    return np.frombuffer(hashlib.shake_256(name.encode()).digest(8 * n), "<u8").copy()


_BYTE = _table("byte", 256) | np.uint64(1)
_BASE = int(_table("base", 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def filled(column: pa.Array) -> pa.Array:
    """The texts with 64-bit offsets; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end, and the n + 1 places between which texts lie."""
    column = filled(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        tables = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
        for t in tables:
            t[0] = 1
        _powers = tuple(np.cumprod(t) for t in tables)
    return _powers


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any stretch."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte stretches, equal for equal bytes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * _power_tables(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the text of each."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    inner = at[(at > 0) & (at < len(data))]  # a text ends a run
    starts[inner] = solid[inner + 1]
    ends[inner - 1] = solid[inner]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(at, first, "right") - 1


def sha256(texts: Iterable[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
