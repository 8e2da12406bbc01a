"""Bitmaps of fixed size that say which rows a join may concern.

A table of keys grows with the data and can't be sent to all tasks; its bitmap
can. A bit that is set by chance only moves a row in vain, so results don't
depend on the size; when nearly all bits are set the join moves all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.packed import ROWS, packed
from kerbline.llm.text import mixed

#: Bits, whatever the number of rows: 4 MB.
BITS = 1 << 25
_RANGES = 64


def spot(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """The bit of a pair of whole numbers."""
    x = np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
    return (mixed(x) & np.uint64(BITS - 1)).astype(np.int64)


def marked(rows: DataFrame) -> np.ndarray:
    """The bitmap of a table of one or two whole-numbered columns."""
    names = rows.columns

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[spot(*(np.asarray(batch.column(c)) for c in names))] = True
        yield packed([(r, [np.packbits(part)]) for r, part in enumerate(bits.reshape(_RANGES, -1)) if part.any()])

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, a in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), strict=True):
                bits[r] = bits.get(r, 0) | np.frombuffer(a, np.uint8)
        yield packed([(r, [b]) for r, b in bits.items()])

    halfway = rows.mapInArrow(mark, ROWS).withColumn("part", F.spark_partition_id() % 16).repartition("bucket", "part").select("bucket", "a").mapInArrow(unite, ROWS)
    out = np.zeros((_RANGES, BITS // 8 // _RANGES), np.uint8)
    for row in halfway.select("bucket", "a").repartition("bucket").mapInArrow(unite, ROWS).select("bucket", "a").collect():
        out[row["bucket"]] = np.frombuffer(bytes(row["a"]), np.uint8)
    return out.ravel()


def hits(bitmap: np.ndarray, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    at = spot(a, b)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def is_marked(bitmap: np.ndarray, key: Column) -> Column:
    """Whether a whole-numbered column's bit is set."""

    @F.pandas_udf("boolean")
    def look(a: pd.Series) -> pd.Series:
        return pd.Series(hits(bitmap, a.to_numpy(np.int64)))

    return look(key)
