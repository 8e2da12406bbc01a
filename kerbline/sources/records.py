"""Records that run over several lines, from files that are read in splits.

Whether a line begins inside a quoted cell depends on all lines before it, but
what a line does to that is a function of two values: it ends outside (or inside)
whatever came before, keeps the state, or turns it round. Such functions compose.
So each split says what it does as a whole, a running composition over the few
rows of splits says in which state each one begins, and its lines are then put
together where they lie. Only a record that crosses the border of a split moves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# What a line does to the state (0 outside, 1 inside a quoted cell).
_OUTSIDE, _TURN, _KEEP, _INSIDE = range(4)


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind a line. A quote opens a cell only as
    its first character; doubled it stands for itself; behind the closing one
    everything belongs to the cell up to the next comma."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


@F.pandas_udf(IntegerType())
def _does(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: _KEEP if '"' not in s and "," not in s else open_after(s, False) | open_after(s, True) << 1)


def _state(turns, fixed, start):
    """The state behind a line (or split): the last fixed one, else that at the start, turned round so many times since."""
    return (turns + F.coalesce(fixed, start)) % 2


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``block``, ``row`` (order of the records), ``record``, the text of
    each with its line feeds, and ``head``, whether it begins its file. A record that is still open at the end of its
    file ends there. Blank lines between records are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    ).withColumn("does", _does("value"))
    split, whole = ["file", "block"], Window.unboundedPreceding
    along = Window.partitionBy(*split).orderBy("row")
    fixes = F.col("does").isin(_OUTSIDE, _INSIDE)
    relative = (
        lines.withColumn("turns", F.sum((F.col("does") == _TURN).cast("int")).over(along))
        .withColumn("fix", F.when(fixes, ((F.col("does") == _INSIDE).cast("int") + F.col("turns")) % 2))
        .withColumn("fixed", F.last("fix", True).over(along.rowsBetween(whole, 0)))
        .withColumn("head", (F.row_number().over(along) == 1) & (F.col("block") == 0))
        .withColumn("fixed_before", F.last("fix", True).over(along.rowsBetween(whole, -1)))
    )

    by_file = Window.partitionBy("file").orderBy("block")
    ends = relative.groupBy(*split).agg(F.max_by(F.struct("turns", "fixed"), "row").alias("e")).select(*split, "e.*")
    ends = (
        ends.withColumn("all_turns", F.sum(F.when(F.col("fixed").isNull(), F.col("turns") % 2).otherwise(0)).over(by_file))
        .withColumn("fix", F.when(F.col("fixed").isNotNull(), (_state(F.col("turns"), F.col("fixed"), F.lit(0)) + F.col("all_turns")) % 2))
        .withColumn("end", _state(F.col("all_turns"), F.last("fix", True).over(by_file.rowsBetween(whole, 0)), F.lit(0)))
    )
    starts = ends.select(*split, F.lag("end", 1, 0).over(by_file).alias("start"))

    before = _state(F.col("turns") - (F.col("does") == _TURN).cast("int"), F.col("fixed_before"), F.col("start"))
    numbered = (
        relative.join(starts, split)
        .withColumn("after", _state(F.col("turns"), F.col("fixed"), F.col("start")))
        .withColumn("opens", F.when(before == 0, F.col("row")))
        .withColumn("first", F.last("opens", True).over(along.rowsBetween(whole, 0)))
    )
    # One row per record and split; no first line: it began in a split before.
    ordered = F.array_sort(F.collect_list(F.struct("row", "value")))
    pieces = numbered.groupBy(*split, "first").agg(
        F.array_join(F.transform(ordered, lambda r: r["value"]), "\n").alias("record"),
        F.max_by("after", "row").alias("open"), F.max("head").alias("head"),
    )
    complete = pieces.where("first IS NOT NULL AND open = 0").select(*split, F.col("first").alias("row"), "record", "head")
    edges = pieces.where("first IS NULL OR open <> 0")
    begun = F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("row")))
    # In a split the end of an older record comes before the one that stays open.
    in_order = Window.partitionBy("file").orderBy("block", F.col("first").asc_nulls_first())
    owned = edges.withColumn("of", F.last(begun, True).over(in_order.rowsBetween(whole, 0)))
    parts = F.array_sort(F.collect_list(F.struct("block", F.coalesce("first", F.lit(-1).cast("bigint")).alias("first"), "record")))
    across = owned.groupBy("file", "of").agg(
        F.array_join(F.transform(parts, lambda r: r["record"]), "\n").alias("record"), F.max("head").alias("head")
    )
    both = complete.unionByName(across.select("file", "of.block", "of.row", "record", "head"))
    return both.where(F.trim(F.regexp_replace("record", "\r", "")) != "")
