"""Table constraints as a frame of violations, and counts taken while rows pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def key_violations(df: DataFrame, key: Sequence[str], not_null: Sequence[str]) -> DataFrame:
    """Keys that are repeated or null, and rows missing a required value: key, problem, rows."""
    key = list(key)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in not_null])
    counted = df.groupBy(*key).agg(
        F.count("*").alias("_rows"), F.count_if(missing).alias("_missing")
    )
    problems = F.filter(
        F.array(
            F.struct(F.when(no_key, "null key").alias("problem"), F.col("_rows").alias("rows")),
            F.struct(F.when(~no_key & (F.col("_rows") > 1), "repeated key").alias("problem"), F.col("_rows").alias("rows")),
            F.struct(F.when(F.col("_missing") > 0, "missing value").alias("problem"), F.col("_missing").alias("rows")),
        ),
        lambda p: p["problem"].isNotNull(),
    )
    return counted.select(*key, F.inline(problems))


class RowCounts:
    """How many rows are left after each step of a load, counted while the one
    job that writes them runs; an object serves one write.

    ``passed`` puts a counter behind a step. Counting adds no pass over the rows:
    every task adds up what goes by. A task that is run again, for a lost
    executor, counts once.
    """

    def __init__(self) -> None:
        self._steps: dict[str, Observation] = {}

    def passed(self, df: DataFrame, step: str) -> DataFrame:
        if step in self._steps:
            raise ValueError(f"step {step!r} is counted already")
        self._steps[step] = Observation(step)
        return df.observe(self._steps[step], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """Rows behind each step; waits for the write to end."""
        return {step: seen.get["rows"] for step, seen in self._steps.items()}

    def dropped(self) -> dict[str, int]:
        """Rows that each step but the first took out."""
        left = list(self.rows().items())
        return {step: before - n for (_, before), (step, n) in zip(left, left[1:], strict=False)}
