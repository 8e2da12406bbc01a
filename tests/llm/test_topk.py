import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import topk


def brute(rows, k, every):
    out = []
    usable = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, rows, k=5, every=10):
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], "id long, vector array<long>, `group` string, score string").repartition(4)
    return sorted(tuple(r) for r in topk.exact_top_k(vectors, F.col("id") % every == 0, k).collect())


def numbers(n, low=-80, high=80, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, rng.integers(low, high, dims).tolist()) for k in range(n)]


def test_random_vectors(spark):
    rows = numbers(200)
    assert got(spark, rows) == brute(rows, 5, 10)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "TILE", 40)
    monkeypatch.setattr(topk, "BINS", 4)
    rows = numbers(80)
    assert got(spark, rows, 3, 20) == brute(rows, 3, 20)


@pytest.mark.parametrize("reach", [2, 10**5, 2**27])
def test_sizes_of_numbers(spark, reach):
    rows = numbers(60, -reach, reach, 4)
    assert got(spark, rows, 4, 15) == brute(rows, 4, 15)


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, [1, 1]) for k in range(40)] + [(100, [2, 0])]
    assert got(spark, rows, 5, 20) == brute(rows, 5, 20)


def test_few_candidates_nulls_and_empty_tables(spark):
    rows = [(0, [3, 4]), (1, [1, 1]), (2, None), (None, [5, 5]), (3, [None, 1]), (4, [-2, 0])]
    assert got(spark, rows) == brute(rows, 5, 10) == [(0, 1, 1, 7), (0, 2, 4, -6)]
    assert got(spark, []) == got(spark, [(1, [1])]) == []
    assert got(spark, [(10, [1, 2])]) == []
    assert got(spark, [(0, [1, 2, 3]), (1, [4]), (2, [])]) == [(0, 1, 1, 4), (0, 2, 2, 0)]


def test_repeated_rows(spark):
    rows = [(0, [1, 0]), (1, [5, 0]), (1, [5, 0]), (2, [4, 0])]
    assert [r[2] for r in got(spark, rows, 3)] == [1, 1, 2]


def test_blocks_meet_groups_one_by_one(spark, monkeypatch):
    """A task holds one block and a few groups: no batch of many joined blocks, and narrow components."""
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    monkeypatch.setattr(topk, "PEAK", 2)
    rows = numbers(120, -40, 40) + [(200 + k, [40] * 8) for k in range(20)]
    vectors = spark.createDataFrame(rows, "id long, vector array<long>").repartition(4)
    found = topk.exact_top_k(vectors, F.col("id") % 10 == 0, 3)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 3, 10)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "MapInPandas" not in plan.replace("FlatMapCoGroupsInPandas", "")
    assert [topk._narrowest(x) for x in (0, 127, 128, 40_000, 2**40)] == ["int8", "int8", "int16", "int32", "int64"]
