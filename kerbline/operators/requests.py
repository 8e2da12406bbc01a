"""Ranking requests: defaults, checks, the rejected ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.fixed_values import (
    DEFAULT_ALTERNATIVES,
    DEFAULT_BUFFER,
    DEFAULT_MODE,
    MAX_ALTERNATIVES,
    MIN_ALTERNATIVES,
    MODES,
)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Fill defaults, lower-case the mode and name the first problem in ``error``."""
    filled = requests.withColumns(
        {
            "buffer_m": F.coalesce("buffer_m", F.lit(DEFAULT_BUFFER)),
            "max_alternatives": F.coalesce("max_alternatives", F.lit(DEFAULT_ALTERNATIVES)),
            "mode": F.lower(F.coalesce("mode", F.lit(DEFAULT_MODE))),
            "use_fixture": F.coalesce("use_fixture", F.lit(False)),
        }
    )

    def no_place(name: str) -> Column:
        """Fewer than two numbers, or one that is missing."""
        place = F.col(name)
        return place.isNull() | (F.size(place) < 2) | F.exists(place, lambda x: x.isNull() | F.isnan(x))

    error = (
        F.when(no_place("start"), "start")
        .when(no_place("end"), "end")
        .when(~((F.col("buffer_m") >= 0) & (F.col("buffer_m") < math.inf)), "buffer_m")
        .when(~F.col("max_alternatives").between(MIN_ALTERNATIVES, MAX_ALTERNATIVES), "max_alternatives")
        .when(~F.col("mode").isin(*MODES), "mode")
    )
    return filled.withColumn("error", error)


def valid_requests(requests: DataFrame) -> DataFrame:
    return checked_requests(requests).filter(F.col("error").isNull()).drop("error")


def rejected_requests(requests: DataFrame) -> DataFrame:
    return checked_requests(requests).filter(F.col("error").isNotNull())
