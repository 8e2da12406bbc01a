"""Codes and labels derived from raw cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.fixed_values import (
    HAZARD_CATEGORIES,
    HAZARD_CATEGORY_OTHER,
    OPEN_STATUS_PATTERNS,
)
from kerbline.functions.parsing import strip


def severity_code(fatalities: Column, seriously_injured: Column) -> Column:
    """1 fatal, 2 serious, 3 minor."""
    return F.when(fatalities > 0, 1).when(seriously_injured > 0, 2).otherwise(3).cast("smallint")


def hazard_status(raw: Column) -> Column:
    """Case status in its short form."""
    text = F.lower(strip(F.coalesce(raw, F.lit(""))))
    return (
        F.when(text == "", "unknown")
        .when(text.startswith("closed"), "closed")
        .when(text.contains("progress"), "in_progress")
        .when(text.startswith("open"), "open")
        .otherwise(F.replace(text, F.lit(" "), F.lit("_")))
    )


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    # A word that contains another word of its list can never decide alone.
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [text.contains(w) for w in needed])


def hazard_category(topic: Column, kind: Column, summary: Column) -> Column:
    """Category by plain substring search over topic, type and whole summary."""
    none = F.lit("")
    text = F.lower(
        F.concat(
            F.coalesce(topic, none), F.lit(" "), F.coalesce(kind, none), F.lit(" "), F.coalesce(summary, none)
        )
    )
    (first, words), *rest = HAZARD_CATEGORIES
    chain = F.when(_any_word(text, words), first)
    for category, words in rest:
        chain = chain.when(_any_word(text, words), category)
    return chain.otherwise(HAZARD_CATEGORY_OTHER)


def bikeway_class(raw: Column) -> Column:
    return F.lower(strip(F.coalesce(raw, F.lit(""))))


def bikeway_status(raw: Column) -> Column:
    return F.upper(strip(F.coalesce(raw, F.lit(""))))


def is_open_hazard(status: Column) -> Column:
    """Whether a status still counts as open (patterns, not equality)."""
    text = F.coalesce(status, F.lit(""))
    return reduce(lambda a, b: a | b, [text.ilike(p) for p in OPEN_STATUS_PATTERNS])
