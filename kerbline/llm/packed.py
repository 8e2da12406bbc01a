"""Rows that carry arrays: many small values to one bucket in one row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

ROWS = "bucket long, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in "abcd")])


def split(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The values that go to each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield int(bucket[a]), [c[a:b] for c in columns]


def packed(rows: Iterable[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
    made = [(bucket, *(c.tobytes() for c in columns), *[None] * (4 - len(columns))) for bucket, columns in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The values of all rows end to end."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)
