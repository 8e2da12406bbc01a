"""Continuous loading: every batch of raw files becomes one delta of clean rows.

A micro-batch writes only its own cleaned rows, into a folder named by its
batch id and overwritten on a retry, so a batch counts once. Readers lay the
deltas over the base snapshot, newest batch first; :func:`compact` writes them
into a new base. State therefore never grows in the stream itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbline.functions.parsing import blank_if_missing
from kerbline.operators.merge import upsert
from kerbline.operators.skew import first_per_key
from kerbline.sources.csv import POSITION, position

BATCH = "batch"
_FILE, _BLOCK = "_file", "_block"


def stream_raw_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """New CSV files of a folder, read as the batch loader reads them: every
    column a text, missing cells empty, headers checked, the place of each row."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    return raw.select(
        *[blank_if_missing(F.col(f"`{c}`")).alias(c) for c in columns],
        F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
    )


def without_repeats(stream: DataFrame, key: Sequence[str], time: Column, delay: str) -> DataFrame:
    """A stream less rows whose key came before, within ``delay`` of event time.

    State is kept for that long only. Rows without a readable time are never
    late: all of them stay, and the keyed merge behind removes their repeats.
    """
    timed = stream.withColumn("_event_time", time.cast("timestamp"))
    known = timed.where(F.col("_event_time").isNotNull()).withWatermark("_event_time", delay)
    once = known.dropDuplicatesWithinWatermark(list(key)).drop("_event_time")
    return once.unionByName(timed.where(F.col("_event_time").isNull()).drop("_event_time"))


def start_load(
    stream: DataFrame,
    clean: Callable[..., DataFrame],
    deltas: str,
    checkpoint: str,
    *,
    now: Callable[[], Column] | None = None,
    **trigger,
) -> StreamingQuery:
    """Clean each batch and write it as a delta; trigger defaults to ``availableNow``.

    ``clean`` gets the batch, and with ``now`` also the time that this gives when
    the batch runs, so that windows move on while the stream does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if {_FILE, _BLOCK} <= set(batch.columns):
            batch = batch.withColumn(POSITION, position(F.col(_FILE), F.col(_BLOCK))).drop(_FILE, _BLOCK)
        cleaned = clean(batch) if now is None else clean(batch, now())
        cleaned.write.mode("overwrite").parquet(f"{deltas}/{BATCH}={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_table(
    base: DataFrame, deltas: DataFrame, key: Sequence[str], keep_if_null: Sequence[str] = ()
) -> DataFrame:
    """Base with every delta applied in batch order.

    Only the newest row per key matters, except for columns that keep their
    last known value: those take the newest value that is not null.
    """
    newest = first_per_key(deltas, key, F.col(BATCH), last=True)
    if keep_if_null:
        known = deltas.groupBy(*key).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(BATCH))).alias(c) for c in keep_if_null]
        )
        newest = newest.drop(*keep_if_null).join(known, list(key))
    return upsert(base, newest.drop(BATCH).select(*base.columns), key, keep_if_null)


def compact(
    base: DataFrame, deltas: DataFrame, key: Sequence[str], path: str, keep_if_null: Sequence[str] = ()
) -> None:
    """Write base and deltas as a new base at another path."""
    current_table(base, deltas, key, keep_if_null).write.mode("overwrite").parquet(path)
