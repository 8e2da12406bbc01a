"""The tile, weight and score functions by name, for queries written in SQL.

``register(spark)`` makes them temporary SQL functions of the session. Their
bodies are SQL, which the optimizer puts in place of the call, so a query with
them plans like one written with columns.

    spark.sql("SELECT crash_id, t.x, t.y FROM crash, LATERAL tile_coord(12, lon, lat) AS t")
    spark.sql("SELECT crash_id, crash_weight(severity, occurred_at, now) FROM crash")
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from kerbline.fixed_values import (
    CRASH_POINTS,
    CRASH_SATURATION,
    EXPOSURE_WEIGHTS,
    HAZARD_POINTS,
    HAZARD_SATURATION,
    MERCATOR_RADIUS,
    RECENCY_HALF_LIFE_MONTHS,
    SCORE_WEIGHTS,
    SECONDS_PER_MONTH,
    TILE_ORIGIN,
    TILE_WORLD,
)


def _number(x: float) -> str:
    return f"{float(x)!r}D" if "e" not in repr(float(x)) else f"CAST('{float(x)!r}' AS DOUBLE)"


def _by_code(table) -> str:
    weights, other = table
    cases = " ".join(f"WHEN {code} THEN {_number(w)}" for code, w in weights.items())
    return f"CASE severity {cases} ELSE {_number(other)} END"


def functions() -> dict[str, str]:
    """The text that creates each function, those that others use first."""
    radius, origin, world = map(_number, (MERCATOR_RADIUS, TILE_ORIGIN, TILE_WORLD))
    scalar = {
        "mercator_x": ("lon DOUBLE", "DOUBLE", f"radians(lon) * {radius}"),
        "mercator_y": ("lat DOUBLE", "DOUBLE", f"ln(tan({_number(math.pi / 4)} + radians(lat) / 2)) * {radius}"),
        "exposure_weight": ("severity INT", "DOUBLE", _by_code(EXPOSURE_WEIGHTS["literal"])),
        "score_weight": ("severity INT", "DOUBLE", _by_code(SCORE_WEIGHTS["literal"])),
        "age_in_months": (
            "happened TIMESTAMP_NTZ, until TIMESTAMP_NTZ", "DOUBLE",
            f"timestampdiff(MICROSECOND, happened, until) / {_number(1e6)} / {_number(SECONDS_PER_MONTH)}",
        ),
        "recency_weight": (
            "happened TIMESTAMP_NTZ, until TIMESTAMP_NTZ", "DOUBLE",
            f"exp({_number(-math.log(2.0))} * age_in_months(happened, until) / {_number(RECENCY_HALF_LIFE_MONTHS)})",
        ),
        "crash_weight": (
            "severity INT, happened TIMESTAMP_NTZ, until TIMESTAMP_NTZ", "DOUBLE",
            "exposure_weight(severity) * recency_weight(happened, until)",
        ),
        "risk_score": (
            "crash_weight_per_km DOUBLE, hazard_per_km DOUBLE", "INT",
            f"CAST(ceil(least((1 - exp(-(crash_weight_per_km / {_number(CRASH_SATURATION)}))) * {_number(CRASH_POINTS)}"
            f" + (1 - exp(-(hazard_per_km / {_number(HAZARD_SATURATION)}))) * {_number(HAZARD_POINTS)}, 100.0D)) AS INT)",
        ),
        "log_score": ("hits BIGINT, busiest BIGINT", "DOUBLE", "least(100.0D, round(100.0D * (log10(1.0D + hits) / log10(1.0D + busiest)), 2))"),
    }
    out = {n: f"CREATE OR REPLACE TEMPORARY FUNCTION {n}({a}) RETURNS {kind} RETURN {body}" for n, (a, kind, body) in scalar.items()}
    # No row for a point outside the projection.
    out["tile_coord"] = f"""CREATE OR REPLACE TEMPORARY FUNCTION tile_coord(zoom INT, lon DOUBLE, lat DOUBLE) RETURNS TABLE (x INT, y INT) RETURN
SELECT CAST(floor((mercator_x(lon) + {origin}) / ({world} / power(2.0D, zoom))) AS INT),
       CAST(floor(({origin} - mercator_y(lat)) / ({world} / power(2.0D, zoom))) AS INT)
WHERE lon BETWEEN -180 AND 180 AND abs(lat) < 90"""
    return out


def register(spark: SparkSession) -> SparkSession:
    """Create the functions in the session; once more does no harm."""
    for text in functions().values():
        spark.sql(text)
    return spark
