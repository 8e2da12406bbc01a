"""Keyed merges into stored tables, without a merge statement: one full outer
join, which reads each side once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """New snapshot: incoming rows replace stored ones of the same key.

    Columns in ``keep_if_null`` keep the stored value where the incoming one
    is null. ``incoming`` must be unique on ``key``.
    """
    key, keep = list(key), set(keep_if_null)
    new = incoming.select(
        *[F.col(c).cast(stored.schema[c].dataType).alias(f"_new_{c}") for c in stored.columns], F.lit(True).alias("_hit")
    )
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_new_{k}") for k in key])

    def merged(c):
        fresh = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in keep else F.col(f"_new_{c}")
        return F.when(F.col("_hit"), fresh).otherwise(F.col(c)).alias(c)

    return stored.join(new, same, "full").select(*[merged(c) for c in stored.columns])


def upsert_crash(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["crash_id"])


def upsert_hazard(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["hazard_id"], keep_if_null=["opened_at", "closed_at"])


def upsert_bikeway(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return upsert(stored, incoming.withColumnRenamed("infra_id", key), [key])
