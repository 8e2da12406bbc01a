"""Lenient casts of raw text cells: bad input becomes null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.fixed_values import NA_WORDS, WHITESPACE

# Spark's own text-to-double cast also takes Java suffixes ("1.5d"), which are
# not numbers here, so the shape of the text is checked first. Digits may be
# grouped with single underscores.
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity)$"

_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)\d*"
_ISO = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T]+" + _CLOCK + r")?\s*(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?"
_US = r"(\d{1,2})/(\d{1,2})/(\d{4})(?:[ T]+" + _CLOCK + r"(?: *([AaPp])\.?[Mm]\.?)?)?"
# No text fits both, so the groups of one of them are empty.
_TIME = rf"^(?:{_ISO}|{_US})$"
_TIME_CELLS = "$1$8-$2$6-$3$7 $4$9|$10|$5"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind an expression once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_if_missing(c: Column) -> Column:
    """Null and the usual NA words become the empty text."""
    return F.when(c.isNull() | c.isin(*NA_WORDS), F.lit("")).otherwise(c)


def lenient_double(c: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return let(
        strip(c), lambda text: F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    )


def lenient_double_with_commas(c: Column) -> Column:
    """As :func:`lenient_double`, thousands separators allowed."""
    return lenient_double(F.replace(strip(c), F.lit(","), F.lit("")))


def lenient_int(c: Column) -> Column:
    """Text to whole number, truncated toward zero; bad or infinite gives 0."""
    def whole(number: Column) -> Column:
        clamped = F.greatest(F.least(number, F.lit(9.0e18)), F.lit(-9.0e18))
        return F.when(F.abs(number) < F.lit(float("inf")), clamped).cast("bigint")

    return F.coalesce(let(lenient_double(c), whole), F.lit(0).cast("bigint"))


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of a zone suffix such as ``+01:30``, ``-0700``, ``Z``."""
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    minutes = (
        F.substring(digits, 1, 2).try_cast("int") * 60
        + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    )
    signed = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    return F.coalesce(signed, F.lit(0))


def _read_time(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of what a text says: the time written (``at``), a or p of a 12-hour clock (``half``), and ``zone``."""

    def cells(text: Column) -> Column:
        return F.when(text.rlike(_TIME), F.split(F.regexp_replace(text, _TIME, _TIME_CELLS), r"\|"))

    def read(cell: Column) -> Column:
        at, half, zone = (F.get(cell, F.lit(i)) for i in range(3))
        return F.struct(at.try_cast("timestamp_ntz").alias("at"), F.lower(half).alias("half"), zone.alias("zone"))

    return let(let(let(strip(c), cells), read), use)


def _local(said: Column) -> Column:
    """The time on a clock of 24 hours."""
    half, hour = said["half"], F.hour(said["at"])
    zero = F.lit(0)
    shift = (
        F.when(half == "", zero)
        .when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
        .when((half == "p") & (hour < 12), 12)
        .when((half == "a") & (hour == 12), -12)
        .otherwise(zero)
    )
    return said["at"] + F.make_dt_interval(zero, shift)


def wall_clock(c: Column) -> Column:
    """Text to a time without zone, as written; unreadable text gives null.

    Reads ISO dates and times (``-`` or ``/`` between the date parts) and US
    month-first dates with a 12- or 24-hour clock. The result does not depend
    on the session time zone.
    """
    return _read_time(c, _local)


def utc_time(c: Column) -> Column:
    """Text to naive UTC: a zone suffix is applied and then dropped."""
    zero = F.lit(0)

    def utc(said: Column) -> Column:
        east = F.when(said["zone"] == "", zero).otherwise(_offset_minutes(said["zone"]))
        return _local(said) - F.make_dt_interval(zero, zero, east)

    return _read_time(c, utc)
