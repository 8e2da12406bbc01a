"""Mixing sources to target weights by pivotal rounding in a reduction tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.storage import written
from kerbline.llm.text import mixed, portions, utf8, words

#: Documents of one source that are rounded together, and residuals that meet in a node of the tree.
LEAF, FAN_IN = 4_096, 64
#: A source is taken at most so many times over.
MOST = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
#: Rows of the table of sources for each source: a hot source's documents meet it in as many places.
SALTS = 32


def sizes(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep`` and ``size``: runs without ASCII white space; null has none."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_column):
            _, _, text = words(*utf8(batch.column(text_column)))
            n = pa.array(np.bincount(text, minlength=batch.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], [*keep, "size"])

    narrow = docs.select(*keep, text_column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return narrow.mapInArrow(count, f"{kinds}, size long")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target``: all sizes together, shared by
    weights that repeat over the sources in code point order (null last). What
    exceeds ``most`` times a source's size is shared again by weight among those
    below, until none is above.

    One row per source, numbered by ranges. The rounds of sharing are sums over
    all sources, of which the driver sees three numbers each."""
    spark = by_source.sparkSession
    ordered = written(
        by_source.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources"
    )
    # The places before a partition of sources: one row per partition.
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("within")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    table = written(ordered.join(before, "part").select("source", "source_size", weight.alias("weight")), "weights")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    share = 0.0  # target per weight of the sources that are not full
    cap = F.lit(most) * F.col("source_size")
    free = total
    open_weight = table.agg(F.sum("weight")).first()[0] or 0.0
    while open_weight:
        share = free / open_weight
        full = cap < F.lit(share) * F.col("weight")
        taken, left = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        left = left or 0.0
        if left == open_weight:
            break
        free, open_weight = total - (taken or 0.0), left
    return table.select("source", "source_size", F.least(cap, F.lit(share) * F.col("weight")).alias("target"))


def _chances(marks: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(11)) / float(1 << 53)


def pivotal(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round fractions ``part`` (0 to 1) so that the sum of size * part stays.

    The largest come first. Of two open fractions one becomes 0 or 1: mass moves
    between them, as much as one can give or take, in a random direction whose
    odds keep every expectation. One open fraction is left at most."""
    size, part, chance = size.tolist(), part.tolist(), chance.tolist()
    held = -1
    for i in sorted(range(len(size)), key=lambda i: -size[i]):  # of equals, in their order
        if not 0.0 < part[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        sa, sb, fa, fb = size[a], size[b], part[a], part[b]
        up, down = min(sa * (1 - fa), sb * fb), min(sa * fa, sb * (1 - fb))
        if chance[i] * (up + down) < down:  # a takes from b
            fills, empties = sa * (1 - fa) <= sb * fb, sb * fb <= sa * (1 - fa)
            part[a], part[b] = 1.0 if fills else fa + up / sa, 0.0 if empties else fb - up / sb
        else:
            empties, fills = sa * fa <= sb * (1 - fb), sb * (1 - fb) <= sa * fa
            part[a], part[b] = 0.0 if empties else fa - down / sa, 1.0 if fills else fb + down / sb
        open_ = [j for j in (a, b) if 0.0 < part[j] < 1.0]
        held = open_[0] if open_ else -1
    return np.array(part)


def pivotal_alike(size: np.ndarray, part: float, chance: np.ndarray) -> np.ndarray:
    """``pivotal`` for documents that all have the fraction ``part``.

    The largest document is paired with all smaller ones together: mass moves
    between it and their common fraction until it is 0 or 1, then the next one's
    turn comes. So large documents are settled while the others can still make
    up for them, and what stays open is among the smallest."""
    order = np.argsort(-size, kind="stable")
    out = np.full(len(size), part)
    rest = np.cumsum(size[order][::-1])[::-1].tolist() + [0]
    for k, (i, s, u) in enumerate(zip(order.tolist(), size[order].tolist(), chance[order].tolist(), strict=True)):
        pool = rest[k + 1]
        up, down = min(s * (1 - part), pool * part), min(s * part, pool * (1 - part))
        if up + down <= 0:
            out[order[k:]] = part
            break
        if u * (up + down) < down:
            out[i] = 1.0 if s * (1 - part) <= pool * part else part + up / s
            part = max(0.0, part - up / pool) if out[i] == 1.0 else 0.0
        else:
            out[i] = 0.0 if s * part <= pool * (1 - part) else part - down / s
            part = min(1.0, part + down / pool) if out[i] == 0.0 else 1.0
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """How often the mix takes each document: the id, ``source``, ``size`` (words:
    runs without ASCII white space), ``source_size``, ``target`` (its source's),
    ``copies`` (int) and ``taken`` (copies times size), one row per row.

    The copies of a document are target / source_size, rounded: the whole part
    is certain, the fraction is a probability. Documents of a source are dealt by
    a hash of the id to leaves of some 4,096, each rounded by ``pivotal_alike``,
    which keeps the number of words; what stays open in a leaf, one document at most,
    goes up a tree of fan-in 64 until one is left per source, which is rounded by
    its probability. So a source's words miss its target by one document, mostly
    a small one. Chance depends on ids and ``seed`` alone: reruns agree.

    Null texts have no words and are never taken. A null source is a source of
    its own, null ids are ids. Rows that share id, source and size count as one
    document and are taken alike. Empty tables give none; other columns are not
    read. Sources without words have target 0.
    """
    narrow = docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), docs[text_column].alias("text"))
    # Each different document once, with the number of its rows.
    units = written(sizes(narrow, ["id", "source"]).groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    by_source = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most)
    blocks = max(1, -(-units.count() // LEAF))
    mark = F.xxhash64(F.lit(seed), "id", "size")
    dealt = units.withColumn("mark", mark).withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumnRenamed("source", "s").withColumnRenamed("salt", "t")
    known = dealt.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t"))).drop("s", "t", "salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = known.withColumn("sure", F.floor(rate).cast("int")).withColumn("part", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0)).withColumn("node", F.pmod(F.shiftright("mark", 8), F.lit(blocks)))
    kind = start.schema.simpleString()[7:-1]
    names = start.columns

    def sorted_(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        frame = frame.sort_values(["mark", "size", "rows"], kind="stable")
        return frame, (frame["size"] * frame["rows"]).to_numpy(), _chances(frame["mark"].to_numpy(), seed + blocks)

    def leaf(frame: pd.DataFrame) -> pd.DataFrame:
        frame, size, chance = sorted_(frame)
        frame["part"] = np.where(size > 0, pivotal_alike(size, float(frame["part"].max()), chance), 0.0)
        return frame[names]

    def node(frame: pd.DataFrame) -> pd.DataFrame:
        frame, size, chance = sorted_(frame)
        frame["part"] = pivotal(size, frame["part"].to_numpy(), chance)
        return frame[names]

    open_ = (F.col("part") > 0) & (F.col("part") < 1)
    level, width = written(start.groupBy("source", "node").applyInPandas(leaf, kind), "leaves"), blocks
    decided = [level.where(~open_)]
    while width > 1:
        width = -(-width // FAN_IN)
        up = level.where(open_).withColumn("node", F.floor(F.col("node") / FAN_IN))
        level = written(up.groupBy("source", "node").applyInPandas(node, kind), "nodes")
        decided.append(level.where(~open_))
    odds = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mark", F.lit("last")), 11) / float(1 << 53)
    decided.append(level.where(open_).withColumn("part", F.when(odds < F.col("part"), 1.0).otherwise(0.0)))
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    copies = F.col("sure") + F.col("part").cast("int")
    return result.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        F.col("id").alias(id_column), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, same columns."""
    taken = mix(docs, id_column=id_column, source_column=source_column, text_column=text_column, **how).where("copies > 0")
    once = taken.select(F.col(id_column).alias("i"), F.col("source").alias("s"), F.col("size").alias("n"), "copies").distinct()
    # All columns as one, so that no name can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_column).alias("text"))
    sized = sizes(whole, ["row"])
    same: Column = F.col(f"row.{id_column}").eqNullSafe(F.col("i")) & F.col(f"row.{source_column}").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    return sized.join(once, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
