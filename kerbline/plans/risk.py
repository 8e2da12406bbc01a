"""Risk scores of lines: saturating density score and logarithmic score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.fixed_values import SCORE_BUFFER_M, SCORE_LOOKBACK_DAYS
from kerbline.functions.geometry import clean_line, parts_from_wkt
from kerbline.functions.scoring import (
    age_months,
    crash_points,
    exposure_severity_weight,
    hazard_points,
    length_km,
    log_score,
    recency_weight,
    risk_score,
    score_severity_weight,
)
from kerbline.functions.vocabulary import is_open_hazard
from kerbline.operators.bounds import near_box
from kerbline.operators.lengths import with_metres
from kerbline.operators.proximity import totals_near_lines
from kerbline.operators.tiles import busiest_tile


def crash_weights(crash: DataFrame, now: Column, scale: str = "literal") -> DataFrame:
    """Severity and recency weight of every crash; a missing time gives no weight."""
    age = age_months(F.col("occurred_at"), now)
    return (
        crash.withColumn("sev_w", exposure_severity_weight(F.col("severity"), scale))
        .withColumn("age_months", age)
        .withColumn("rec_w", recency_weight(F.col("age_months")))
        .withColumn("weight", F.col("sev_w") * F.col("rec_w"))
    )


def since(df: DataFrame, time: str, moment: Column) -> Column:
    """Whether a row's time is not before ``moment``; a stored table's ``year`` spares whole folders."""
    recent = F.col(time) >= moment
    return (F.col("year") >= F.year(moment)) & recent if "year" in df.columns else recent


def recent_crashes(crash: DataFrame, now: Column, days: int) -> DataFrame:
    return crash.filter(since(crash, "occurred_at", now - F.make_dt_interval(F.lit(days))))


def active_hazards(hazard: DataFrame, now: Column, days: int) -> DataFrame:
    """Open hazards of the window: opened in it, and not closed before it."""
    begin = now - F.make_dt_interval(F.lit(days))
    return hazard.filter(
        is_open_hazard(F.col("status"))
        & (F.col("closed_at").isNull() | (F.col("closed_at") >= begin))
        & since(hazard, "opened_at", begin)
    )


def score_lines(
    lines: DataFrame,
    crash: DataFrame,
    hazard: DataFrame,
    *,
    now: Column,
    key: Sequence[str],
    lookback_days: int = SCORE_LOOKBACK_DAYS,
    buffer_m: float = SCORE_BUFFER_M,
    scale: str = "literal",
    prune: bool = False,
) -> DataFrame:
    """Risk score 0..100 per line with its diagnostics, distances in metres.

    Crashes and hazards go through one join as one stream of points with three
    measures, so the line side is cut into cells and shuffled once. ``prune``
    reads only the points in the box around the lines (:mod:`operators.bounds`),
    for a call about few lines, or lines that lie close together.
    """
    key = list(key)
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    if prune:
        crash, hazard = (near_box(p, lines, parts="parts", reach=buffer_m, metric="geodesic") for p in (crash, hazard))
    crashes = recent_crashes(crash, now, lookback_days).select(
        "lon", "lat", one.alias("crashes"),
        score_severity_weight(F.col("severity"), scale).cast("bigint").alias("crash_weight"),
        zero.alias("open_hazards"),
    )
    hazards = active_hazards(hazard, now, lookback_days).select(
        "lon", "lat", zero.alias("crashes"), zero.alias("crash_weight"), one.alias("open_hazards")
    )
    measures = ["crashes", "crash_weight", "open_hazards"]
    shaped = lines.select(*key, clean_line(F.col("parts")).alias("parts"), F.lit(float(buffer_m)).alias("radius"))
    totals = totals_near_lines(
        shaped, crashes.unionByName(hazards), key=key, radius="radius", metric="geodesic", measures=measures,
        radii=[buffer_m], combine=not prune,
    )
    measured = with_metres(shaped.select(*key, "parts"))
    return _with_scores(
        measured.select(*key, length_km(F.col("metres")).alias("length_km"))
        .join(totals, key, "left")
        .withColumns({m: F.coalesce(m, zero) for m in measures})
    ).withColumns({"lookback_days": F.lit(lookback_days), "buffer_m": F.lit(float(buffer_m))})


def _with_scores(df: DataFrame) -> DataFrame:
    return (
        df.withColumns(
            {
                "crash_cnt_per_km": F.col("crashes") / F.col("length_km"),
                "crash_weight_per_km": F.col("crash_weight") / F.col("length_km"),
                "hazard_per_km": F.col("open_hazards") / F.col("length_km"),
            }
        )
        .withColumns(
            {
                "crash_points": crash_points(F.col("crash_weight_per_km")),
                "hazard_points": hazard_points(F.col("hazard_per_km")),
            }
        )
        .withColumn("score", risk_score(F.col("crash_points"), F.col("hazard_points")))
    )


def score_wkt(lines: DataFrame, crash: DataFrame, hazard: DataFrame, *, wkt: str = "wkt", **options) -> DataFrame:
    """As :func:`score_lines` for lines given as text; unreadable text is left out."""
    # Generated, not selected: so a text is parsed once and not again for every use of its parts.
    readable = F.filter(F.array(parts_from_wkt(F.col(wkt))), lambda p: p.isNotNull())
    parsed = lines.select(*[c for c in lines.columns if c != "parts"], F.explode(readable).alias("parts"))
    return score_lines(parsed, crash, hazard, **options)


def score_bikeway(
    bikeway: DataFrame, crash: DataFrame, hazard: DataFrame, infra_id: str | None = None, **options
) -> DataFrame:
    """Scores of stored bikeways, or of one, which reads only the points around it; an unknown id gives no row."""
    chosen = bikeway if infra_id is None else bikeway.filter(F.col("infra_id") == infra_id)
    return score_lines(chosen, crash, hazard, key=["infra_id"], **{"prune": infra_id is not None, **options})


def risk_payload(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """The nested form of a scored frame, as JSON text."""
    payload = F.struct(
        F.struct("lookback_days", "buffer_m").alias("params"),
        F.col("length_km"),
        F.struct("crashes", "crash_weight", "open_hazards").alias("counts"),
        F.struct("crash_cnt_per_km", "crash_weight_per_km", "hazard_per_km").alias("densities"),
        F.struct("crash_points", "hazard_points").alias("component_pts"),
        F.col("score"),
    )
    return scored.select(*key, F.to_json(payload).alias("payload"))


def log_scores(
    lines: DataFrame,
    crash: DataFrame,
    tiles: DataFrame,
    *,
    key: Sequence[str],
    buffer: float,
    prune: bool = False,
) -> DataFrame:
    """Crashes in the buffer (Mercator units) against the busiest tile. ``prune``
    as for :func:`score_lines`."""
    key = list(key)
    if prune:
        crash = near_box(crash, lines, parts="parts", reach=buffer, metric="mercator")
    shaped = lines.select(*key, "parts", F.lit(float(buffer)).alias("radius"))
    totals = totals_near_lines(
        shaped, crash.select("lon", "lat", F.lit(1).cast("bigint").alias("crashes")), key=key, radius="radius",
        metric="mercator", measures=["crashes"], radii=[buffer], combine=not prune,
    )
    hits = F.coalesce("crashes", F.lit(0).cast("bigint"))
    return shaped.select(*key).join(totals, key, "left").select(
        *key, hits.alias("crashes"), F.lit(round(buffer)).alias("buffer_m"),
        log_score(hits, busiest_tile(tiles).scalar()).alias("score"),
    )


def severity_mix(crash: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Crashes per severity with their share, over the table or per group."""
    counts = crash.groupBy(*by, "severity").agg(F.count("*").alias("crashes"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("crashes").alias("_all"))
        shared = counts.join(totals, list(by)).withColumn("share", F.col("crashes") / F.col("_all")).drop("_all")
        return shared
    return counts.withColumn("share", F.col("crashes") / crash.agg(F.count("*")).scalar())


def load_report(**tables: DataFrame) -> DataFrame:
    """Row count per named table."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    report = counts[0]
    for one in counts[1:]:
        report = report.unionByName(one)
    return report
