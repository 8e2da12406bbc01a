"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.storage import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``edges``
    (a, b: long). Rounds of two joins on narrow rows: each node hangs its larger
    neighbours on its smallest one, then itself and its smaller ones on the
    smallest of them, until the links are stars. Smallest neighbours are found
    with sums in the tasks first, and a hot node's links are split by the joins,
    so no task gathers the neighbours of a node."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours go to the smallest one (a node's own number counts).
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = written(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1_000_003), F.sum(F.col("b") % 1_000_003)).first())
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
