"""Raw CSV exports: every cell a text, headers found by alias."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.parsing import blank_if_missing
from kerbline.sources.records import read_records

# Order of a row in its source: file, then place in the file.
POSITION = "_position"


def read_raw_csv(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """All columns as text, missing cells as the empty text, plus ``_position``.

    Files are read in splits, whether or not records run over several lines
    (:mod:`sources.records`), at the cost of one shuffle; ``multi_line=False``
    says that none does, and saves it. All files have the same header.
    """
    plain = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    if multi_line is False:
        return plain.select(
            *[blank_if_missing(F.col(f"`{c}`")).alias(c) for c in plain.columns],
            position(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias(POSITION),
        )
    text = F.regexp_replace("record", "^\ufeff", "")
    text = F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    kind = ", ".join(f"`{c.replace('`', '``')}` string" for c in plain.columns)
    cells = F.from_csv(text, kind, {"quote": '"', "escape": '"'})
    read = read_records(spark, path).select("file", "block", "row", "head", cells.alias("cells"))
    name = lambda c: F.col("cells").getField(c)
    # A blank header has got a name, a repeated one a number behind it.
    same = reduce(lambda a, b: a & b, [F.coalesce(F.lit(c).startswith(name(c)), F.lit(True)) for c in plain.columns])
    other = F.raise_error(F.concat(F.lit("another header in "), "file")).cast("boolean")
    return read.where(F.when(~F.col("head"), True).when(same, False).otherwise(other)).select(
        *[blank_if_missing(name(c)).alias(c) for c in plain.columns], F.struct("file", "block", "row").alias(POSITION)
    )


def position(file: Column, block: Column) -> Column:
    """Where a row stands; to be asked for right at the scan, while rows are in file order."""
    return F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row"))


def resolve_headers(
    columns: Sequence[str], aliases: Mapping[str, Sequence[str]], required: Sequence[str], what: str
) -> dict[str, str | None]:
    """Actual header per canonical name, first alias wins; fails naming what is missing."""
    found = {name: next((a for a in names if a in columns), None) for name, names in aliases.items()}
    missing = [name for name in required if found[name] is None]
    if missing:
        raise ValueError(f"missing required columns in {what}: {missing}; found: {list(columns)}")
    return found


def canonical(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str], what: str
) -> DataFrame:
    """Select the canonical columns; optional ones that are absent become the empty text."""
    found = resolve_headers(df.columns, aliases, required, what)

    def column(name: str) -> Column:
        header = found[name]
        return F.lit("") if header is None else F.coalesce(F.col(f"`{header}`"), F.lit(""))

    if POSITION not in df.columns:
        raise ValueError(f"{what} rows need their place in a column {POSITION}: which of several is the first depends on it")
    return df.select(*[column(name).alias(name) for name in aliases], POSITION)
