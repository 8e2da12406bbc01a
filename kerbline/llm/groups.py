"""Whole groups in a task, from rows that come sorted by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """``rows`` for comparing all members of a group pair by pair, with columns
    ``block_a``, ``block_b`` and ``side``: a group of more than about ``block``
    members is cut into blocks by a hash, and each two blocks meet in a task of
    their own. A member goes to as many tasks as its group has blocks; side is 0
    where a block meets itself, else 1 or 2."""
    size = rows.groupBy(group).agg(F.count("*").alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    known = rows.join(size, group).withColumn("_own", own)
    other = known.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return other.select(*rows.columns, F.least("_own", "_other").alias("block_a"), F.greatest("_own", "_other").alias("block_b"), side.alias("side"))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups and where in them groups start. A group over
    many batches is put together once, when the next one begins."""
    held: list[pa.RecordBatch] = []
    last: list = []

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    def put_together(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, cut(table)

    for batch in batches:
        if not batch.num_rows:
            continue
        goes_on = bool(held) and [batch.column(k)[0].as_py() for k in keys] == last
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        begin = int(cut(pa.Table.from_batches([batch]))[-1])  # of the batch's last group
        if goes_on and begin == 0:
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, begin)] if begin else held
        # A copy of the last group, so that it doesn't hold on to the whole batch.
        held = [batch.take(pa.array(np.arange(begin, batch.num_rows)))]
        batch = None
        if ready:
            yield put_together(ready)
        ready = None
    if held:
        yield put_together(held)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that links a-b connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label
