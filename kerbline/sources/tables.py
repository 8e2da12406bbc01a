"""Stored tables: reading, spreading, writing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.geometry import cell_id, mercator_x, mercator_y, tile_x, tile_y

SNAPSHOT_ZOOM = 17


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with its schema stated, no file is opened before it runs."""
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def write_point_snapshot(df: DataFrame, path: str, time: str, key: str) -> None:
    """Points by year, sorted by grid cell inside a year.

    Lookback filters skip whole years, and row-group statistics on ``lon`` and
    ``lat`` skip places. Ranges are cut on the key last, so that one busy cell
    fills several files rather than one task.
    """
    cell = cell_id(tile_x(mercator_x(F.col("lon")), SNAPSHOT_ZOOM), tile_y(mercator_y(F.col("lat")), SNAPSHOT_ZOOM))
    placed = df.withColumns({"year": F.year(time), "_cell": cell})
    (
        placed.repartitionByRange("year", "_cell", key)
        .sortWithinPartitions("year", "_cell", key)
        .drop("_cell")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def write_text(df: DataFrame, path: str) -> None:
    """A one-column text frame, one document or Feature per line."""
    df.write.mode("overwrite").text(path)
