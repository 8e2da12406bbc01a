import pytest

from kerbline.session import local_session


# Column expressions in the test modules need a running session at import.
SESSION = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def one(spark):
    """Evaluate a column over literal rows of one text column ``t``."""

    def run(values, column, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
        return [r[0] for r in df.orderBy("i").select(column).collect()]

    return run
