"""Merges that rewrite only the buckets they hit, against one full outer join."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kerbline.operators.merge import upsert
from kerbline.plans import ingest
from kerbline.sources import buckets
from kerbline.workload import queries
from kerbline.workload import tables as t

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    table = spark.range(5_000).selectExpr("CAST(id AS STRING) AS k", "id AS n", "CAST(id AS DOUBLE) AS x")
    buckets.write_buckets(table, path, ["k"], 40)
    return table, path


def test_a_small_batch_leaves_other_files_as_they_are(spark, stored):
    table, path = stored
    before = files(path)
    assert len(before) == 40
    placed = spark.read.parquet(path)
    # One per cent of the keys, in three buckets; and a new key in one of them.
    few = placed.where("bucket < 3").limit(50).selectExpr("k", "n + 1000000 AS n", "CAST(NULL AS DOUBLE) AS x")
    keys = spark.range(5_000, 6_000).selectExpr("CAST(id AS STRING) AS k", "id AS n", "1e0 AS x")
    new = keys.where(buckets._bucket(["k"], 40) == 1).limit(1)
    batch = spark.createDataFrame(few.unionByName(new).collect(), "k string, n long, x double")
    want = rows(upsert(table, batch, ["k"], ["x"]))
    hit = buckets.merge_into_buckets(spark, path, batch, ["k"], ["x"])
    assert hit and set(hit) <= {0, 1, 2}
    assert rows(buckets.read_buckets(spark, path)) == want
    after = files(path)
    untouched = {f: v for f, v in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in hit}
    assert len(untouched) == 40 - len(hit)
    assert all(after.get(f) == v for f, v in untouched.items())
    # What was hit was written anew.
    assert not (before.keys() - untouched.keys()) & after.keys()


@pytest.mark.parametrize("limit", [buckets.BROADCAST_BYTES, 0])
def test_merges_follow_one_another(spark, stored, monkeypatch, limit):
    monkeypatch.setattr(buckets, "BROADCAST_BYTES", limit)
    table, path = stored
    want = table
    for step in range(3):
        batch = spark.range(step * 7, 6_000, 1_500).selectExpr("id AS k", f"id * {step} AS n", "IF(id % 2 = 0, NULL, 5e0) AS x")
        buckets.merge_into_buckets(spark, path, batch, ["k"])
        want = upsert(want, batch, ["k"])
    assert rows(buckets.read_buckets(spark, path)) == rows(want)


def test_an_empty_batch_rewrites_nothing_and_a_null_key_raises(spark, stored):
    table, path = stored
    before = files(path)
    assert buckets.merge_into_buckets(spark, path, table.limit(0), ["k"]) == []
    with pytest.raises(ValueError, match="no \\['k'\\]"):
        buckets.merge_into_buckets(spark, path, spark.createDataFrame([(None, 1, 1.0)], "k string, n long, x double"), ["k"])
    assert files(path) == before
    with pytest.raises(ValueError, match="buckets, not 0"):
        buckets.write_buckets(table, path + "-0", ["k"], 0)
    assert not os.path.exists(path + "-0")


def test_the_stored_side_is_not_shuffled(spark, stored):
    """Stored rows are joined where they are read, and only the buckets hit are read."""
    _, path = stored
    table = spark.read.parquet(path)
    few = table.where("bucket = 7").limit(20)
    batch = spark.createDataFrame(few.drop("of_buckets").collect(), few.drop("of_buckets").schema)
    merged = buckets.laid_over(table.where(F.col("bucket").isin([7])), batch, ["k", "n", "x"], ["k"], set(), True)
    assert merged.count() == table.where("bucket = 7").count()
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan
    assert "PartitionFilters: [isnotnull(bu" in plan


@needs_tables
@pytest.mark.parametrize("name", ["crash", "hazard", "bikeway"])
def test_equal_to_the_full_outer_join_of_every_merge_query(spark, tmp_path, name):
    if name == "crash":
        stored, incoming = queries._crash_batches(spark, SF)
        key, keep, want = ["crash_id"], [], queries.upsert_crash(stored, incoming)
    elif name == "hazard":
        stored, incoming = queries._hazard_batches(spark, SF)
        key, keep, want = ["hazard_id"], ["opened_at", "closed_at"], queries.upsert_hazard(stored, incoming)
    else:
        stored, incoming = t.bikeway(spark, SF), ingest.clean_bikeway(t.raw_bikeway(spark, SF))
        key, keep, want = ["infra_id"], [], queries.upsert_bikeway(stored, incoming, "infra_id")
    path = str(tmp_path / name)
    buckets.write_buckets(stored, path, key, 6)
    buckets.merge_into_buckets(spark, path, incoming, key, keep)
    assert rows(buckets.read_buckets(spark, path)) == rows(want)
