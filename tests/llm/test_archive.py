import hashlib

import pytest
from pyspark.sql import functions as F

from kerbline.llm import archive
from kerbline.llm.queries import QUERIES

LONG, OTHER, SHORT = "<p>é same page</p>" * 20, "<b>another</b>" * 30, "<i>short</i>"
ROWS = [(5, "http://a/5", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "http://b/\r\nX: y", OTHER), (7, "u", SHORT), (8, "u", SHORT), (4, "n", None), (None, "null id", LONG), (None, "only", OTHER * 2)]


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, header string").repartition(3)

    return make


def read(spark, pages, rows, path):
    archive.write_archive(pages(rows), str(path))
    return archive.read_archive(spark, str(path))


def test_records_come_back(spark, pages, tmp_path):
    got = read(spark, pages, ROWS, tmp_path / "a").collect()
    assert len(got) == len(ROWS)
    by_id = {(r["page_id"], r["url"]): r for r in got}
    for i, u, h in ROWS:
        data = (h or "").encode()
        r = by_id[(i, u and u.replace("\r", "%0D").replace("\n", "%0A"))]
        first = {LONG: 2, OTHER: 3}.get(h)
        again = first is not None and i != first
        assert bytes(r["payload"]) == data and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))
        record = bytes(r["record"])
        head, _, body = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert body == (b"" if again else data) + b"\r\n\r\n"
        assert f"Content-Length: {0 if again else len(data)}".encode() in head.split(b"\r\n")
        assert all(b": " in line for line in head.split(b"\r\n")[1:])


def test_payloads_are_stored_once(spark, pages, tmp_path):
    read(spark, pages, ROWS * 3, tmp_path / "a")
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == stored.select("digest").distinct().count() == 5


def test_damage_is_found(spark, pages, tmp_path):
    read(spark, pages, ROWS, tmp_path / "a")
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(str(tmp_path / "b/payloads"))
    stored.where("length(payload) < 50").write.parquet(str(tmp_path / "c/payloads"))
    for other, what in (("b", "damaged payload"), ("c", "no payload")):
        spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / other / "headers"))
        with pytest.raises(Exception, match=what):
            archive.read_archive(spark, str(tmp_path / other)).collect()


def test_records_are_weighed_by_their_bytes(spark, pages, tmp_path):
    got = archive.weighed(read(spark, pages, ROWS, tmp_path / "a")).collect()
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in ROWS]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)


def test_the_query_finds_a_wrong_length(spark, monkeypatch):
    write = archive.write_archive

    def damaged(pages, path):
        write(pages, f"{path}-whole")
        spark.read.parquet(f"{path}-whole/payloads").write.parquet(f"{path}/payloads")
        header = F.regexp_replace(F.col("header").cast("string"), "Content-Length: ([0-9]+)", "Content-Length: 1$1").cast("binary")
        spark.read.parquet(f"{path}-whole/headers").withColumn("header", header).write.parquet(f"{path}/headers")

    monkeypatch.setattr(archive, "write_archive", damaged)
    with pytest.raises(Exception, match="Content-Length differs"):
        QUERIES["op6_warc"](spark, "/root/testdata/sf0.001").collect()


def test_repeated_rows_and_empty_tables(spark, pages, tmp_path):
    got = read(spark, pages, [(1, "u", LONG)] * 2 + [(2, "u", LONG)], tmp_path / "a").collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 1) == [(1, "response", None)] * 2
    assert read(spark, pages, [], tmp_path / "b").collect() == []


def test_export(spark, pages, tmp_path):
    records = read(spark, pages, ROWS[:4], tmp_path / "a")
    archive.export_warc(records.coalesce(1), str(tmp_path / "warc"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert sorted(data.split(b"WARC/1.1\r\n")[1:]) == sorted(bytes(r["record"])[10:] for r in records.collect())
