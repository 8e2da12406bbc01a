import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from kerbline.operators.quality import RowCounts
from kerbline.plans import ingest, risk
from kerbline.sources import csv, routes, tables
from kerbline.streaming import alerts, load

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _write(path, text):
    path.write_text(text, newline="")
    return str(path)


CRASH_CSV = (
    "incident_id,geo_lon,geo_lat,first_occurrence_date,FATALITIES,SERIOUSLY_INJURED\n"
    "1,-105,39.7,2024-01-01 00:00:00,0,0\n"
    "1,-104,39.7,2024-01-02 00:00:00,1,0\n"
    "2,abc,39.7,2024-01-01 00:00:00,0,0\n"
    "2,-103,39.7,2024-01-01T00:00:00-07:00,x,2.9\n"
    "3,-105,NA,2024-01-01 00:00:00,0,0\n"
    "4,-105,39.7,zz,0,0\n"
    "5,-105,39.7,2018-01-01 00:00:00,0,0\n"
    "6,-105,39.7,02/01/2019 12:00:00 AM,1,1\n"
)


def test_load_crash(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "crash.csv", CRASH_CSV))
    got = ingest.clean_crash(raw, now()).orderBy("crash_id").collect()
    assert [(r.crash_id, str(r.occurred_at), r.severity, r.lon) for r in got] == [
        ("1", "2024-01-01 00:00:00", 3, -105.0), ("2", "2024-01-01 07:00:00", 2, -103.0), ("6", "2019-02-01 00:00:00", 1, -105.0),
    ]


def test_files_in_name_order(spark, tmp_path):
    head = "objectid,lon,lat,occurred_at\n"
    _write(tmp_path / "b.csv", head + "1,2,2,2024-01-01\n" * 50)
    _write(tmp_path / "a.csv", head + "1,1,1,2024-01-01\n")
    raw = csv.read_raw_csv(spark, str(tmp_path))
    assert [r.lon for r in ingest.clean_crash(raw, now()).collect()] == [1.0]


def test_embedded_newlines(spark, tmp_path):
    plain = _write(tmp_path / "plain.csv", 'a,b\n1,"x ""y"""\n')
    broken = _write(tmp_path / "broken.csv", 'a,b\n1,"x\ny"\n2,"NA"\n')
    assert [r.b for r in csv.read_raw_csv(spark, plain).collect()] == ['x "y"']
    assert [r.b for r in csv.read_raw_csv(spark, plain, multi_line=False).collect()] == ['x "y"']
    assert [r.b for r in csv.read_raw_csv(spark, broken).orderBy("_position").collect()] == ["x\ny", ""]
    assert sorted(r.b for r in csv.read_raw_csv(spark, str(tmp_path)).collect()) == ["", "x\ny", 'x "y"']


def test_missing_columns(spark):
    raw = spark.createDataFrame([("1", "2", 0)], "incident_id string, lon string, _position int")
    with pytest.raises(ValueError, match=r"\['lat', 'time'\].*incident_id"):
        ingest.clean_crash(raw, now())


def test_first_alias_wins(spark):
    raw = spark.createDataFrame([("a", "b", "1", "2", "2024-01-01", "5", 0)], "OBJECTID string, object_id string, lon string, lat string, occurred_at string, lat2 string, _position int")
    assert [r.crash_id for r in ingest.clean_crash(raw, now()).collect()] == ["b"]


HAZARD_CSV = (
    'OBJECTID,Longitude,Latitude,Case Status,Case Created dttm,Topic,Case Summary\n'
    '1,-105,39.7,Closed - Done,01/15/2024 01:00:00 PM,Streets,"big\npothole, with ice"\n'
    '2,-105,39.7,,01/15/2022 01:00:00 PM,Streets,old\n'
    '3,-105,39.7,,,Streets,no time\n'
)


def test_load_hazard(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "h.csv", HAZARD_CSV))
    got = ingest.clean_hazard(raw, now()).collect()
    assert [(r.hazard_id, r.category, r.status, str(r.opened_at), r.closed_at) for r in got] == [
        ("1", "pothole", "closed", "2024-01-15 13:00:00", None)
    ]


def test_window_needs_a_time(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "h.csv", HAZARD_CSV)).filter("OBJECTID = '3'")
    got = ingest.clean_hazard(raw, now()).collect()
    assert [(r.hazard_id, r.status, r.opened_at) for r in got] == [("3", "unknown", None)]


def test_load_bikeway(spark, tmp_path):
    text = (
        "FID,fac_type,status,geom\n"
        '1, Trail ,existing,"LINESTRING (3143000 1696000, 3144000 1697000)"\n'
        '1,PAINTED,,"multilinestring((3143000 1696000,3144000 1697000),(3143000 1696000,3143500 1696500))"\n'
        "2,x,y,POINT(1 2)\n3,x,y,\n4,x,y,LINESTRING(a b)\n"
    )
    raw = csv.read_raw_csv(spark, _write(tmp_path / "b.csv", text))
    got = ingest.clean_bikeway(raw).collect()
    assert [(r.infra_id, r["class"], r.on_off, r.status, len(r.parts)) for r in got] == [("1", "painted", "", "", 2)]
    v = got[0].parts[0][0]
    assert abs(v.lon + 104.9915) < 1e-3 and abs(v.lat - 39.7432) < 1e-3
    flat = ingest.clean_bikeway(raw, srid=4326).collect()[0].parts[0][0]
    assert (flat.lon, flat.lat) == (3143000.0, 1696000.0)


def test_loads_merge_into_the_stored_table(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "crash.csv", CRASH_CSV))
    stored = ingest.clean_crash(raw, now()).filter("crash_id = '1'").withColumn("lon", F.lit(0.0))
    assert sorted((r.crash_id, r.lon) for r in ingest.load_crash(raw, stored, now()).collect()) == [("1", -105.0), ("2", -103.0), ("6", -105.0)]


def test_bikeway_key(spark):
    assert ingest.bikeway_key(spark.sql("select 1 id, 2 way_id")) == "way_id"
    with pytest.raises(ValueError):
        ingest.bikeway_key(spark.sql("select 1 x"))


DOCUMENT = {
    "code": "Ok",
    "routes": [
        {"geometry": {"type": "LineString", "coordinates": [[-105.0, 39.7], [-104.9, 39.7]]}, "distance": 5667, "duration": 598.5,
         "legs": [{"steps": [], "distance": 5667, "summary": ""}]},
        {"geometry": {"coordinates": []}, "distance": 1},
        {"legs": [{"distance": 10.5}, {}]},
    ],
    "waypoints": [],
}


def test_route_documents(spark, tmp_path):
    for name in ("router_cycling.json", "router.json"):
        (tmp_path / name).write_text(json.dumps(DOCUMENT, indent=1))
    documents = routes.read_route_documents(spark, str(tmp_path))
    assert {r.file: r.mode for r in documents.collect()} == {"router_cycling.json": "cycling", "router.json": "driving"}
    got = routes.explode_routes(documents.filter("mode = 'cycling'"), "mode").orderBy("index").collect()
    assert [(r["index"], len(r.vertices), r.distance) for r in got] == [(0, 2, 5667.0), (1, 0, 1.0), (2, 0, None)]


def test_snapshot_prunes_years(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "crash.csv", CRASH_CSV))
    path = str(tmp_path / "snapshot")
    cleaned = ingest.clean_crash(raw, now())
    tables.write_point_snapshot(cleaned, path, "occurred_at", "crash_id")
    back = tables.read_table(spark, path)
    assert back.count() == 3 and set(back.columns) == {*cleaned.columns, "year"}
    recent = risk.recent_crashes(back, now(), 40)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2023" in plan
    assert recent.count() == risk.recent_crashes(cleaned, now(), 40).count() == 2


def test_time_filter_reaches_the_scan(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "crash.csv", CRASH_CSV))
    path = str(tmp_path / "crash")
    ingest.clean_crash(raw, now()).write.parquet(path)
    plan = risk.recent_crashes(spark.read.parquet(path), now(), 30)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(occurred_at,2024-01-02T00:00)" in plan


def test_load_report(spark):
    assert sorted(map(tuple, risk.load_report(a=spark.range(3), b=spark.range(0)).collect())) == [("a", 3), ("b", 0)]


def test_a_load_counts_its_rows_as_it_writes_them(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "c.csv", CRASH_CSV))
    counts = RowCounts()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        ingest.clean_crash(raw, now(), counts=counts).write.parquet(str(tmp_path / "out"))
        before = set(jobs.getJobIdsForGroup("counted"))
        assert counts.rows() == {"read": 8, "place": 6, "time": 4, "first id": 3}
        assert set(jobs.getJobIdsForGroup("counted")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts.dropped() == {"place": 2, "time": 2, "first id": 1}
    assert counts.rows()["first id"] == spark.read.parquet(str(tmp_path / "out")).count()
    assert ingest.clean_crash(raw, now()).count() == 3
    with pytest.raises(ValueError):
        counts.passed(raw, "read")


def test_counts_equal_the_load_report(spark, tmp_path):
    from kerbline.workload import tables as t

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    for name, raw, clean, last in (
        ("crash", t.raw_crash, lambda r, c: ingest.clean_crash(r, now(), counts=c), "first id"),
        ("hazard", t.raw_hazard, lambda r, c: ingest.clean_hazard(r, now(), counts=c), "first id"),
        ("bikeway", t.raw_bikeway, lambda r, c: ingest.clean_bikeway(r, counts=c), "last id"),
    ):
        counts, path = RowCounts(), str(tmp_path / name)
        clean(raw(spark, sf), counts).write.parquet(path)
        written = spark.read.parquet(path)
        assert risk.load_report(**{name: written}).first()["rows"] == counts.rows()[last]
        assert counts.rows()["read"] == raw(spark, sf).count()
        assert counts.rows()["read"] - sum(counts.dropped().values()) == counts.rows()[last]


# --- streams ------------------------------------------------------------------------


def test_incremental_load(spark, tmp_path):
    source, deltas, checkpoint = (str(tmp_path / n) for n in ("in", "deltas", "checkpoint"))
    (tmp_path / "in").mkdir()
    columns = ["incident_id", "geo_lon", "geo_lat", "first_occurrence_date", "FATALITIES", "SERIOUSLY_INJURED"]

    def run():
        stream = load.stream_raw_csv(spark, source, columns)
        load.start_load(stream, lambda batch: ingest.clean_crash(batch, now()), deltas, checkpoint).awaitTermination(120)

    _write(tmp_path / "in" / "1.csv", CRASH_CSV)
    run()
    _write(tmp_path / "in" / "2.csv", CRASH_CSV.splitlines()[0] + "\n1,-99,39.7,2024-01-03 00:00:00,1,0\n7,-98,39.7,2024-01-03 00:00:00,0,0\n")
    run()
    schema = "crash_id string, occurred_at timestamp_ntz, severity smallint, lon double, lat double"
    base = spark.createDataFrame([("9", None, 3, 0.0, 0.0)], schema)
    read = spark.read.schema(schema + ", batch int").parquet(deltas)
    current = load.current_table(base, read, ["crash_id"])
    want = [("1", -99.0), ("2", -103.0), ("6", -105.0), ("7", -98.0), ("9", 0.0)]
    assert sorted((r.crash_id, r.lon) for r in current.collect()) == want
    load.compact(base, read, ["crash_id"], str(tmp_path / "base2"))
    assert spark.read.parquet(str(tmp_path / "base2")).count() == 5


def test_a_stream_loads_what_a_batch_loads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = HAZARD_CSV + "4,-105,39.7,NA,01/15/2024 01:00:00 AM,N/A,n/a\n4,-104,39.7,open,01/15/2024 01:00:00 AM,x,y\n"
    path = _write(tmp_path / "in" / "1.csv", text)
    columns = text.split("\n", 1)[0].split(",")
    stream = load.stream_raw_csv(spark, str(tmp_path / "in"), columns)
    moments = []

    def clock():
        moments.append(1)
        return now()

    load.start_load(stream, ingest.clean_hazard, str(tmp_path / "out"), str(tmp_path / "cp"), now=clock).awaitTermination(120)
    batch = ingest.clean_hazard(csv.read_raw_csv(spark, path), now())
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())) == sorted(map(str, batch.collect()))
    assert moments == [1]
    assert {r.hazard_id: (r.status, r.lon) for r in batch.collect()}["4"] == ("unknown", -105.0)


def test_the_window_of_a_stream_counts_the_table(spark, tmp_path):
    raw = csv.read_raw_csv(spark, _write(tmp_path / "h.csv", HAZARD_CSV)).filter("OBJECTID = '3'")
    table = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "opened_at timestamp_ntz")
    assert ingest.clean_hazard(raw, now(), table=table).collect() == []


def test_repeats_within_the_watermark_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "1.csv", "id,t\n1,2024-01-01 00:00:00\n1,2024-01-01 00:05:00\n2,2024-01-01 00:00:00\n")
    stream = load.stream_raw_csv(spark, str(tmp_path / "in"), ["id", "t"])
    once = load.without_repeats(stream, ["id"], F.to_timestamp("t"), "1 hour")
    out = str(tmp_path / "out")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_rows_without_a_time_stay_when_the_watermark_has_moved(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for name, rows in (("1.csv", "1,2024-01-01 00:00:00\n2,\n"), ("2.csv", "3,\n4,2024-01-01 00:10:00\n4,2024-01-01 00:11:00\n")):
        _write(tmp_path / "in" / name, "id,t\n" + rows)
        stream = load.stream_raw_csv(spark, str(tmp_path / "in"), ["id", "t"])
        time = F.to_timestamp(F.when(F.col("t") != "", F.col("t")))
        load.without_repeats(stream, ["id"], time, "1 hour").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "4"]


def test_deltas_keep_last_known_times(spark):
    base = spark.createDataFrame([("1", "open", "a"), ("2", "open", "b")], "id string, status string, opened string")
    deltas = spark.createDataFrame([("1", "x", "c", 0), ("1", "y", None, 1), ("2", "z", None, 1)], "id string, status string, opened string, batch int")
    got = load.current_table(base, deltas, ["id"], keep_if_null=["opened"])
    assert sorted(map(tuple, got.collect())) == [("1", "y", "c"), ("2", "z", "b")]


def test_hazard_alerts_as_a_stream(spark, tmp_path):
    line = "array<array<struct<lon:double,lat:double>>>"
    lines = spark.createDataFrame([("u", "r", [[{"lon": -105.0, "lat": 39.7}, {"lon": -104.99, "lat": 39.7}]])], f"user_id string, route_id string, parts {line}")
    key = ["user_id", "route_id"]
    alerts.watch_cells(lines, key).write.parquet(str(tmp_path / "cells"))
    watched = spark.read.parquet(str(tmp_path / "cells"))
    schema = "hazard_id string, category string, status string, opened_at timestamp_ntz, closed_at timestamp_ntz, lon double, lat double"
    rows = [("1", "ice", "open", None, None, -104.995, 39.7003), ("2", "ice", "open", None, None, -104.995, 39.71), ("3", "ice", "closed", None, None, -104.995, 39.7)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "hazards"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "hazards"))
    out = str(tmp_path / "alerts")
    alerted = alerts.hazard_alerts(stream, watched, key)
    alerted.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(out).collect()] == [("u", "r", "1")]


def test_cells_of_saved_lines_are_never_broadcast(spark):
    """The engine takes cells for as small as the lines that they come from."""
    line = "array<array<struct<lon:double,lat:double>>>"
    shape = [[{"lon": -105.0, "lat": 39.7}, {"lon": -104.9, "lat": 39.7}]]
    lines = spark.createDataFrame([("u", "r", shape), ("v", "r", shape)], f"user_id string, route_id string, parts {line}")
    schema = "hazard_id string, category string, status string, opened_at timestamp_ntz, lon double, lat double"
    hazards = spark.createDataFrame([("1", "ice", "open", None, -104.995, 39.7003), ("2", "ice", "open", None, -104.995, 39.71)], schema)
    key = ["user_id", "route_id"]
    found = alerts.hazard_alerts(hazards, alerts.watch_cells(lines, key), key)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("u", "r", "1"), ("v", "r", "1")]


def test_digests_as_a_stream_and_what_came_too_late(spark, tmp_path):
    schema = "line_id string, hazard_id string, category string, opened_at timestamp_ntz"
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    files = [
        [("a", "1", "ice", day(1, 3)), ("a", "2", "ice", day(1, 9)), ("a", "3", "pothole", day(2)), ("b", "1", "ice", day(1, 3)), ("b", "9", "ice", None)],
        [("a", "4", "ice", day(2, 23)), ("a", "5", "ice", day(6))],  # the last ends all windows to day 4
        [("a", "6", "ice", day(1, 12)), ("a", "7", "ice", day(5, 1)), ("b", "8", "ice", day(9))],  # the first is late
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "digests")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        digests = alerts.hazard_digests(spark.readStream.schema(schema).parquet(source), ["line_id"], delay="2 days")
        digests.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True
        ).start().awaitTermination(120)
    told, every = spark.read.parquet(out), spark.read.parquet(source)
    got = {tuple(r) for r in told.collect()}
    batch = {tuple(r) for r in alerts.hazard_digests(every.filter("hazard_id <> '6'"), ["line_id"]).collect()}
    ended = {r for r in batch if r[3] <= day(7)}  # the newest alert is of day 9
    assert got == ended and len(got) == 6
    late = {tuple(r) for r in alerts.late_alerts(every, told, ["line_id"]).collect()}
    assert late == {("a", "ice", day(1), 3, 1), ("b", "ice", day(9), 1, 1)}


@pytest.mark.parametrize("zone", ["UTC", "America/Denver"])
def test_digest_windows_are_wall_clock(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(1969, 12, 31, 23, 0, 0, 5)]
        rows = spark.createDataFrame([("a", "ice", x) for x in times], "k string, category string, opened_at timestamp_ntz")
        got = {(r.window_start, r.window_end, r.first_at) for r in alerts.hazard_digests(rows, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day = dt.timedelta(days=1)
    assert got == {(dt.datetime(x.year, x.month, x.day), dt.datetime(x.year, x.month, x.day) + day, x) for x in times}


def test_a_cell_is_read_once(spark):
    raw = spark.createDataFrame(
        [("1", "-104.9", "39.7", "2024-01-02 03:04:05", "1", "0", 0)],
        "incident_id string, geo_lon string, geo_lat string, first_occurrence_date string, FATALITIES string, SERIOUSLY_INJURED string, _position long",
    )
    clean = ingest.clean_crash(raw, F.lit("2024-02-01").cast("timestamp_ntz"))
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    # A text is trimmed where it is read: the five cells once each, whatever filters by the results.
    assert plan.count("trim(") == 5
    assert [r.crash_id for r in clean.collect()] == ["1"]
