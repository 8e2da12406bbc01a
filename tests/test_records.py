"""Records over several lines, read in splits, against reading each file whole."""

import csv as standard
import io
import random

import pytest

from kerbline.sources import csv, records

CELLS = ["x", "a\nb", 'q"uote', "", "long\n" * 20, "\n\n", '""', "c,d", "é, ü", " lead"]


def written(path, rows, end="\n"):
    out = io.StringIO(newline="")
    standard.writer(out, lineterminator=end).writerows([["a", "b c", "d.e"], *rows])
    path.write_text(out.getvalue(), newline="")
    return str(path)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole(spark, path):
    read = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return [tuple(v or "" for v in r) for r in read.collect()]


def in_order(df):
    return [tuple(r)[:-1] for r in df.orderBy("_position").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_give_the_rows_and_order_of_the_whole(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    rows = [[str(k), rng.choice(CELLS), rng.choice(CELLS)] for k in range(60)]
    path = written(tmp_path / "one.csv", rows, end)
    got = csv.read_raw_csv(spark, path)
    assert in_order(got) == whole(spark, path) == [tuple(r) for r in rows]
    places = {r["_position"]["block"] for r in got.collect()}
    assert len(places) >= 8


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path, small_splits):
    text = 'a,b,c\n1,5" pipe,x\n2,"y\n,""z\n",3" w\n\n3,,"open at the end\n"'
    (tmp_path / "odd.csv").write_text(text, newline="")
    path = str(tmp_path / "odd.csv")
    assert in_order(csv.read_raw_csv(spark, path)) == whole(spark, path) == [
        ("1", '5" pipe', "x"), ("2", 'y\n,"z\n', '3" w'), ("3", "", "open at the end\n")]


def test_several_files_one_record_over_many_splits(spark, tmp_path, small_splits):
    written(tmp_path / "b.csv", [["1", "n\n" * 500, "x"], ["2", "", ""]])
    written(tmp_path / "a.csv", [["3", "y", "z"]])
    (tmp_path / "c.csv").write_text("")
    got = in_order(csv.read_raw_csv(spark, [str(tmp_path / f) for f in ("b.csv", "a.csv")]))
    assert got == [("3", "y", "z"), ("1", "n\n" * 500, "x"), ("2", "", "")]


def test_another_header_raises(spark, tmp_path):
    written(tmp_path / "a.csv", [["1", "x", "y"]])
    (tmp_path / "b.csv").write_text("b c,a,d.e\n1,2,3\n")
    with pytest.raises(Exception, match="another header in .*csv"):
        csv.read_raw_csv(spark, str(tmp_path)).collect()


def test_what_a_line_does_to_the_state():
    after = lambda s: (records.open_after(s, False), records.open_after(s, True))
    assert after("plain,text") == (False, True)
    assert after('a,"b') == (True, False)
    assert after('"x""') == (True, False)
    assert after('5" pipe') == (False, False)
    assert after('x",y') == (False, False)
    assert after('"') == (True, False)
    assert after("") == (False, True)
