"""Cells of saved lines: few rows, and the same alerts as with the finest ones."""

from pyspark.sql import functions as F

from kerbline.functions.geometry import LINE_TYPE
from kerbline.operators.proximity import CELL_ZOOM
from kerbline.streaming import alerts


def test_a_line_has_few_cells_and_all_its_alerts(spark):
    lines = spark.createDataFrame(
        [(f"u{k}", [[(-105.0 + 0.01 * k + 0.008 * j, 39.7 + 0.003 * j * (-1) ** j) for j in range(6)]]) for k in range(20)], f"user_id string, parts {LINE_TYPE}"
    )
    hazards = spark.range(4000).select(
        F.col("id").cast("string").alias("hazard_id"), F.lit("x").alias("category"), F.lit("Open").alias("status"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("opened_at"), (F.col("id") * 7919 % 4001 * 6e-5 - 105.0).alias("lon"), (F.col("id") * 104729 % 4003 * 1e-5 + 39.68).alias("lat"),
    )
    found = {}
    for zoom in (CELL_ZOOM, alerts.WATCH_ZOOM):
        cells = alerts.watch_cells(lines, ["user_id"], zoom=zoom)
        found[zoom] = sorted(map(tuple, alerts.hazard_alerts(hazards, cells, ["user_id"], zoom=zoom).collect()))
    assert found[CELL_ZOOM] == found[alerts.WATCH_ZOOM] and len(found[CELL_ZOOM]) > 100
    assert alerts.watch_cells(lines, ["user_id"]).count() < alerts.watch_cells(lines, ["user_id"], zoom=CELL_ZOOM).count() / 4
