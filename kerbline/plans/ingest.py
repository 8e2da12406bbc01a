"""Loaders: raw text tables to clean, de-duplicated point and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.fixed_values import (
    BIKEWAY_HEADERS,
    BIKEWAY_KEYS,
    BIKEWAY_REQUIRED,
    CRASH_HEADERS,
    CRASH_HISTORY_YEARS,
    CRASH_REQUIRED,
    HAZARD_HEADERS,
    HAZARD_HISTORY_DAYS,
    HAZARD_REQUIRED,
)
from kerbline.functions.geometry import parts_from_wkt, to_wgs84
from kerbline.functions.parsing import lenient_double, lenient_int, strip, utc_time, wall_clock
from kerbline.functions.vocabulary import (
    bikeway_class,
    bikeway_status,
    hazard_category,
    hazard_status,
    severity_code,
)
from kerbline.operators.merge import upsert_bikeway, upsert_crash, upsert_hazard
from kerbline.operators.quality import RowCounts
from kerbline.operators.skew import first_per_key
from kerbline.sources.csv import POSITION, canonical


def _usable_points(df: DataFrame) -> DataFrame:
    """Numeric lon and lat; rows lacking either, or holding NaN, go."""
    return _read_once(df, lon=lenient_double(F.col("lon")), lat=lenient_double(F.col("lat"))).filter(
        F.col("lon").isNotNull() & F.col("lat").isNotNull()
    )


def _read_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns read from text cells, to be filtered by. Generated, not selected:
    a filter that moves below a selection reads the text a second time."""
    read = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_read")
    return df.select(*[c for c in df.columns if c not in columns], read).select(
        *[c for c in df.columns if c not in columns], "_read.*"
    )


def _passed(df: DataFrame, step: str, counts: RowCounts | None) -> DataFrame:
    return df if counts is None else counts.passed(df, step)


def clean_crash(
    raw: DataFrame, now: Column, years: int = CRASH_HISTORY_YEARS, counts: RowCounts | None = None
) -> DataFrame:
    """Crashes of the last years with a readable place and time, first row per id.

    ``counts`` takes the rows ``read``, those with a ``place``, a ``time`` inside
    the years, and a ``first id``.
    """
    read = _passed(canonical(raw, CRASH_HEADERS, CRASH_REQUIRED, "crash"), "read", counts)
    df = _passed(_usable_points(read), "place", counts)
    df = _read_once(df, occurred_at=utc_time(F.col("time"))).filter(
        F.col("occurred_at") >= now - F.make_ym_interval(F.lit(years))
    )
    df = _passed(df, "time", counts).select(
        F.col("id").alias("crash_id"),
        "occurred_at",
        severity_code(lenient_int(F.col("fatalities")), lenient_int(F.col("seriously_injured"))).alias("severity"),
        "lon",
        "lat",
        POSITION,
    )
    return _passed(first_per_key(df, ["crash_id"], F.col(POSITION)).drop(POSITION), "first id", counts)


def clean_hazard(
    raw: DataFrame,
    now: Column,
    days: int = HAZARD_HISTORY_DAYS,
    table: DataFrame | None = None,
    counts: RowCounts | None = None,
) -> DataFrame:
    """Hazards with a readable place, first row per id.

    The time window applies only if any row has a time at all; then rows
    without one go too. A stream hands in the ``table`` that it adds to, whose
    rows count as well. Times are local wall clock, as written. ``counts`` takes
    the rows ``read``, those with a ``place``, inside the ``window``, with a ``first id``.
    """
    read = _passed(canonical(raw, HAZARD_HEADERS, HAZARD_REQUIRED, "hazard"), "read", counts)
    df = _passed(_usable_points(read), "place", counts).select(
        F.col("id").alias("hazard_id"),
        hazard_category(F.col("topic"), F.col("type"), F.col("summary")).alias("category"),
        hazard_status(F.col("status")).alias("status"),
        wall_clock(F.col("created_at")).alias("opened_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        "lon",
        "lat",
        POSITION,
    )
    recent = _passed(within_window(df, "opened_at", now, days, table), "window", counts)
    return _passed(first_per_key(recent, ["hazard_id"], F.col(POSITION)).drop(POSITION), "first id", counts)


def within_window(df: DataFrame, time: str, now: Column, days: int, table: DataFrame | None = None) -> DataFrame:
    """Rows of the last days, or every row where no row has a time, there or in ``table``."""
    any_time = df.agg((F.count(time) > 0).alias("any_time")).scalar()
    if table is not None:
        any_time = any_time | table.agg((F.count(time) > 0).alias("any_time")).scalar()
    return df.filter(~any_time | (F.col(time) >= now - F.make_dt_interval(F.lit(days))))


def clean_bikeway(raw: DataFrame, srid: int = 2232, counts: RowCounts | None = None) -> DataFrame:
    """Bikeway lines in WGS84, last row per id; rows without a readable line go.

    ``counts`` takes the rows ``read``, those with a readable ``line``, and a ``last id``.
    """
    df = _passed(canonical(raw, BIKEWAY_HEADERS, BIKEWAY_REQUIRED, "bikeway"), "read", counts)
    text = strip(F.col("wkt"))
    df = df.filter(F.upper(text).contains("LINESTRING")).select(
        F.col("id").alias("infra_id"),
        bikeway_class(F.col("type")).alias("class"),
        F.lit("").alias("on_off"),
        bikeway_status(F.col("status")).alias("status"),
        to_wgs84(parts_from_wkt(text), srid).alias("parts"),
        POSITION,
    )
    readable = _passed(df.filter(F.col("parts").isNotNull()), "line", counts)
    return _passed(first_per_key(readable, ["infra_id"], F.col(POSITION), last=True).drop(POSITION), "last id", counts)


def bikeway_key(stored: DataFrame) -> str:
    """The key column a stored bikeway table uses."""
    for name in BIKEWAY_KEYS:
        if name in stored.columns:
            return name
    raise ValueError(f"no key column among {BIKEWAY_KEYS} in {stored.columns}")


def load_crash(raw: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """New crash snapshot after a raw batch."""
    return upsert_crash(stored, clean_crash(raw, now))


def load_hazard(raw: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """New hazard snapshot after a raw batch."""
    return upsert_hazard(stored, clean_hazard(raw, now))


def load_bikeway(raw: DataFrame, stored: DataFrame, srid: int = 2232) -> DataFrame:
    """New bikeway snapshot after a raw batch."""
    return upsert_bikeway(stored, clean_bikeway(raw, srid), bikeway_key(stored))
