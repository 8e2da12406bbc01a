"""Groups of any size: numbering their rows, and keeping one row per key.

A key may hold a third of all rows. Joins leave such keys to the engine, which
cuts a skewed partition of a join at run time; what needs a group's rows in
order deals them out by ranges instead of by group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank", first: dict[str, str] | None = None
) -> DataFrame:
    """Number the rows of each group from 1 by ascending ``order`` columns.

    ``order`` must be unique within a group. ``first`` maps new columns to
    columns whose value is taken from the group's first row.

    Rows are dealt out by ranges of (group, order), so a large group spans
    several tasks and a task counts along its sorted rows. Only the first group
    of a task can have begun before it: two rows per task say how many rows of
    its groups came before and what their first row holds.
    """
    group, first = list(group), first or {}
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    own = [StructField(f.name, f.dataType, True) for f in df.schema]
    added = [StructField(f"_first_{n}", df.schema[c].dataType, True) for n, c in first.items()]
    counted = [StructField("_task", IntegerType()), StructField("_n", LongType()), StructField("_edge", BooleanType())]
    schema = StructType([*own, *counted, *added])
    names, sources = [f.name for f in own], list(first.values())

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before, n, firsts, opening = TaskContext.get().partitionId(), None, 0, None, None

        def edge(batch: pa.RecordBatch, key: tuple, size: int, values: list) -> pa.RecordBatch:
            """A row that carries the size of a group's stretch in this task."""
            of = dict(zip(group, key, strict=True))
            columns = [pa.array([of.get(c)], batch.schema.field(c).type) for c in names]
            columns += [pa.array([task], pa.int32()), pa.array([size], pa.int64()), pa.array([True])]
            return pa.RecordBatch.from_arrays([*columns, *values], [f.name for f in schema])

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for c in group:
                codes = batch.column(c).dictionary_encode("encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            key = tuple(batch.column(c)[0].as_py() for c in group)
            change[0] = key != before
            starts = np.flatnonzero(change)
            place = np.arange(batch.num_rows)
            run = np.cumsum(change) - 1  # -1: goes on from the batch before
            begin = starts[np.maximum(run, 0)] if len(starts) else np.zeros_like(place)
            numbers = np.where(run < 0, n + place + 1, place - begin + 1)
            values = []
            for k, c in enumerate(sources):
                column = batch.column(c)
                held = column.slice(0, 1) if firsts is None else firsts[k]
                pool = pa.concat_arrays([held, column])
                values.append(pool.take(pa.array(np.where(run < 0, 0, begin + 1))))
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in group)
            if before is not None and opening is None and len(starts):
                # The task's first stretch has ended, in this batch or with the one before.
                opening = edge(batch, before, int(n + starts[0]), firsts)
            elif before is None and len(starts) > 1:
                opening = edge(batch, key, int(starts[1]), [v.slice(0, 1) for v in values])
            columns = [*batch.columns, pa.array(np.full(len(place), task, np.int32)), pa.array(numbers), pa.array(np.zeros(len(place), bool))]
            yield pa.RecordBatch.from_arrays([*columns, *values], [f.name for f in schema])
            before, n, firsts = last, int(numbers[-1]), [v.slice(len(place) - 1, 1) for v in values]
            closing = batch
        if before is not None:
            if opening is not None:
                yield opening
            yield edge(closing, before, n, firsts)

    numbered = ranged.mapInArrow(number, schema)
    along = Window.partitionBy(*group).orderBy("_task")
    shift = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begun = numbered.filter("_edge").select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_task").alias("_at"), shift.alias("_shift"),
        *[F.first(f"_first_{n}").over(along).alias(f"_begun_{n}") for n in first],
    ).filter(F.col("_shift").isNotNull())
    # At most one row per task.
    same = F.col("_task") == F.col("_at")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    whole = numbered.filter(~F.col("_edge")).join(F.broadcast(begun), same, "left")
    goes_on = F.col("_shift").isNotNull()
    return whole.select(
        *names,
        (F.col("_n") + F.coalesce("_shift", F.lit(0))).cast("int").alias(rank),
        *[F.when(goes_on, F.col(f"_begun_{n}")).otherwise(F.col(f"_first_{n}")).alias(n) for n in first],
    )


def first_per_key(df: DataFrame, key: Sequence[str], position: Column, last: bool = False) -> DataFrame:
    """The first (or last) row per key by position.

    An aggregate rather than a window: each task keeps one row per key before
    the shuffle, so copies of a hot key never travel together.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*key).agg(pick(F.struct(*rest), position).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
