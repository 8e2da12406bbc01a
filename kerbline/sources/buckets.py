"""Stored tables dealt into key buckets, so that a batch rewrites only what it hits.

A row's bucket follows from a hash of its key; each bucket is a folder. A merge
reads the buckets of the batch's keys and no others, joins the batch to them as it
lies, and puts new folders in place of these; all other files stay as they are.
The number of buckets is part of the path, so the table says it itself. More
buckets mean less to rewrite for a small batch, and more files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition columns: the number of buckets, and a row's bucket.
OF, BUCKET = "of_buckets", "bucket"
#: The numbers of the buckets that a batch hits go to the driver.
MOST_BUCKETS = 100_000
#: A batch of up to so many bytes (as text) goes to the tasks that read the buckets; a
#: larger one and the buckets that it hits are shuffled by key.
BROADCAST_BYTES = 64 << 20


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: Sequence[str], buckets: int) -> None:
    """Store a table anew, a file per bucket. Buckets get equal shares whatever
    the keys, which are unique."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets, not {buckets}")
    if {OF, BUCKET} & set(df.columns):
        raise ValueError(f"columns {OF} and {BUCKET} are those of the folders")
    placed = df.withColumns({OF: F.lit(buckets), BUCKET: _bucket(key, buckets)})
    placed.repartition(BUCKET).sortWithinPartitions(BUCKET, *key).write.mode("overwrite").partitionBy(OF, BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The whole table, without the columns of the folders."""
    return spark.read.parquet(path).drop(OF, BUCKET)


def laid_over(
    stored: DataFrame, batch: DataFrame, columns: Sequence[str], key: Sequence[str], keep: set[str], small: bool
) -> DataFrame:
    """The rows of the buckets hit after a batch, both with their bucket; the
    stored ones are not shuffled if the batch is ``small`` enough for all tasks."""
    sent = F.broadcast if small else lambda df: df
    new = batch.select(*[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_new_{k}") for k in key])

    def merged(c: str) -> Column:
        fresh = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in keep else F.col(f"_new_{c}")
        return F.when(F.col("_hit"), fresh).otherwise(F.col(c)).alias(c)

    replaced = stored.join(sent(new), same, "left").select(*[merged(c) for c in columns], BUCKET)
    # Keys that are stored already: no more than the batch has.
    known = stored.select(*key).join(sent(batch.select(*key)), key, "left_semi")
    added = batch.join(sent(known), key, "left_anti").select(*columns, BUCKET)
    return replaced.unionByName(added)


def merge_into_buckets(
    spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], keep_if_null: Sequence[str] = ()
) -> list[int]:
    """Lay a batch over a stored table and give the numbers of the rewritten buckets.

    The table is then what :func:`operators.merge.upsert` makes of it: rows of
    the batch replace stored ones of the same key, columns in ``keep_if_null``
    keep the stored value where the batch's is null, other keys are added. The
    batch is unique on ``key`` and holds no null in it; it is read several times,
    so a caller whose batch is dear to make stores it first. An empty batch
    rewrites nothing.

    Stored rows stay in the tasks that read them while the batch is no larger
    than ``BROADCAST_BYTES``, which is measured first.
    """
    key, keep = list(key), set(keep_if_null)
    table = spark.read.parquet(path)
    of = table.select(OF).first()
    if of is None:
        raise ValueError(f"{path} has no rows and so no number of buckets: write it anew")
    columns = [c for c in table.columns if c not in (OF, BUCKET)]
    batch = incoming.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in columns])
    if batch.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])).limit(1).count():
        raise ValueError(f"a row of the batch has no {key}")
    batch = batch.withColumn(BUCKET, _bucket(key, of[0]))
    weights = batch.groupBy(BUCKET).agg(F.sum(F.length(F.to_json(F.struct(*columns)))).alias("n")).collect()
    hit = sorted(r[BUCKET] for r in weights)
    if not hit:
        return []
    small = sum(r["n"] for r in weights) <= BROADCAST_BYTES
    stored = table.where((F.col(OF) == of[0]) & F.col(BUCKET).isin(hit))
    fresh = laid_over(stored, batch, columns, key, keep, small).withColumn(OF, F.lit(of[0]))
    (
        fresh.select(*columns, OF, BUCKET).sortWithinPartitions(BUCKET)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(OF, BUCKET).parquet(path)
    )
    return hit
