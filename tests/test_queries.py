"""Every named query against its independent SQL, on the smallest data set."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from kerbline.workload.oracles import oracles
from kerbline.workload.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, db, name):
    from check import _rows

    df = entry.queries()[name](spark, str(SF))
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracles())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, str(SF)).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_building_a_query_starts_no_job(spark, name):
    spark.sparkContext.setJobGroup(f"building {name}", "")
    try:
        QUERIES[name](spark, str(SF))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"building {name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entry(spark):
    assert entry.entry(spark).columns == ["request_id", "mode", "index", "length_km", "crashes", "rank", "is_winner"]
