"""Crash, hazard, bikeway and route tables computed from the test tables.

No test table carries coordinates, so they follow from integer keys. Every
table uses all rows of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.vocabulary import hazard_category, hazard_status
from kerbline.sources.tables import read_table

# The fixed "now" of all queries.
NOW = "2024-02-01 00:00:00"

_POINT = """
  CASE WHEN {id} % 5 < 2 THEN -1.05e2 + (({id} * 7919) % 10007) * 4e-2 / 1.0007e4
       ELSE -1.0511e2 + (({id} * 104729) % 10007) * 5e-1 / 1.0007e4 END AS lon,
  CASE WHEN {id} % 5 < 2 THEN 3.973e1 + (({id} * 6101) % 10009) * 3e-2 / 1.0009e4
       ELSE 3.961e1 + (({id} * 7561) % 10009) * 3e-1 / 1.0009e4 END AS lat"""


def point(id_column: str) -> str:
    """SQL for the lon and lat of a keyed point; valid in Spark and DuckDB."""
    return _POINT.format(id=id_column)


def vertex_lon(group: str, line: str, j: str) -> str:
    return (
        f"-1.0506e2 + (({group} * 7919) % 1009) * 6e-2 / 1.009e3"
        f" + ((({group} * 31) % 101) * 4e-4 + 2e-2) * {j} / 5e0"
        f" + CASE WHEN {j} BETWEEN 1 AND 4 THEN ((({line} * ({j} + 3) * 31) % 1009) - 504) * 4e-3 / 5.04e2 ELSE 0e0 END"
    )


def vertex_lat(group: str, line: str, j: str) -> str:
    return (
        f"3.97e1 + (({group} * 6101) % 1009) * 6e-2 / 1.009e3"
        f" + ((({group} * 37) % 101) * 4e-4) * {j} / 5e0"
        f" + CASE WHEN {j} BETWEEN 1 AND 4 THEN ((({line} * ({j} + 7) * 17) % 1009) - 504) * 4e-3 / 5.04e2 ELSE 0e0 END"
    )


def _vertices(group: str, line: str, count: int) -> str:
    one = "named_struct('lon', {lon}, 'lat', {lat})"
    return "array(" + ", ".join(
        one.format(lon=vertex_lon(group, line, str(j)), lat=vertex_lat(group, line, str(j))) for j in range(count)
    ) + ")"


# Stated schemas: nothing has to be read before a query is built.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS crash_id",
        "CAST(ts AS TIMESTAMP_NTZ) AS occurred_at",
        "CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS SMALLINT) AS severity",
        *_point_columns("event_id"),
    )


def dirty_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crashes, some of them at places that no map has."""
    k = "CAST(crash_id AS BIGINT)"
    return crash(spark, sf_dir).selectExpr(
        "crash_id", "occurred_at", "severity",
        f"CASE WHEN {k} % 50 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN {k} % 50 = 1 THEN CAST(NULL AS DOUBLE) ELSE lon END AS lon",
        f"CASE WHEN {k} % 50 IN (2, 3) THEN 9.5e1 WHEN {k} % 50 = 4 THEN CAST('NaN' AS DOUBLE) ELSE lat END AS lat",
    )


def _point_columns(id_column: str) -> list[str]:
    lon, lat = point(id_column).split(" AS lon,")
    return [f"{lon.strip()} AS lon", lat.strip()]


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking request per customer; those without orders stay empty."""
    k = "c_custkey"
    return _read(spark, sf_dir, "customer").selectExpr(
        f"{k} AS request_id",
        f"array({vertex_lon(k, k, '0')}, {vertex_lat(k, k, '0')}) AS start",
        f"array({vertex_lon(k, k, '5')}, {vertex_lat(k, k, '5')}) AS end",
        f"CASE WHEN {k} % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE 3e1 + 1e1 * ({k} % 4) END AS buffer_m",
        f"CASE WHEN {k} % 11 = 0 THEN 6 WHEN {k} % 3 = 0 THEN CAST(NULL AS INT)"
        f" ELSE CAST({k} % 5 + 1 AS INT) END AS max_alternatives",
        f"CASE {k} % 7 WHEN 0 THEN 'bus' WHEN 1 THEN 'Driving' WHEN 2 THEN 'cycling' WHEN 3 THEN 'WALKING'"
        " ELSE CAST(NULL AS STRING) END AS mode",
        "CAST(NULL AS BOOLEAN) AS use_fixture",
    )


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route per order; the orders of a customer are the alternatives."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS request_id",
        "CAST(o_orderkey AS INT) AS index",
        f"{_vertices('o_custkey', 'o_orderkey', 6)} AS vertices",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 5e1 END AS distance",
        "o_totalprice / 2e2 AS duration",
        "CASE WHEN o_orderkey % 3 = 0 THEN array(named_struct('distance', o_totalprice / 1e2),"
        " named_struct('distance', o_totalprice / 1e2)) END AS legs",
    )


HAZARD_STATUS = (
    "CASE doc_id % 7 WHEN 0 THEN 'Open' WHEN 1 THEN 'Closed - Done' WHEN 2 THEN 'In Progress' WHEN 3 THEN ''"
    " WHEN 4 THEN 'Re-Opened' WHEN 5 THEN 'Pending Closure' ELSE 'New' END"
)


def hazard_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS hazard_id",
        "source AS topic",
        "lang AS kind",
        "text AS summary",
        f"{HAZARD_STATUS} AS raw_status",
        f"TIMESTAMP_NTZ '{NOW}' - make_dt_interval(CAST(doc_id % 500 AS INT)) AS opened_at",
        f"CASE WHEN doc_id % 7 = 1 THEN TIMESTAMP_NTZ '{NOW}' - make_dt_interval(CAST(doc_id % 500 AS INT) - 3) END"
        " AS closed_at",
        *_point_columns("doc_id"),
    )


def bikeway(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "s_suppkey"
    return _read(spark, sf_dir, "supplier").selectExpr(
        f"CAST({k} AS STRING) AS infra_id",
        "CASE s_nationkey % 6 WHEN 0 THEN 'protected' WHEN 1 THEN 'buffered' WHEN 2 THEN 'painted'"
        " WHEN 3 THEN 'shared' WHEN 4 THEN 'trail' ELSE 'unpaved' END AS class",
        "'' AS on_off",
        "CASE s_nationkey % 3 WHEN 0 THEN 'EXISTING' WHEN 1 THEN 'PROPOSED' ELSE 'UNKNOWN' END AS status",
        f"array({_vertices(k, k, 3)}, {_vertices(k, f'(1000 + {k})', 3)}) AS parts",
    )


def user_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return _read(spark, sf_dir, "customer").selectExpr(
        f"CAST({k} AS STRING) AS user_id",
        "'home' AS route_id",
        "c_name AS name",
        f"TIMESTAMP_NTZ '{NOW}' AS created_at",
        f"array({_vertices(k, k, 6)}) AS parts",
    )


def hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hazard_raw(spark, sf_dir).select(
        "hazard_id",
        hazard_category(F.col("topic"), F.col("kind"), F.col("summary")).alias("category"),
        hazard_status(F.col("raw_status")).alias("status"),
        "opened_at",
        "closed_at",
        "lon",
        "lat",
    )


# --- raw tables, every cell a text ---------------------------------------------

# Digits of the coordinates of raw rows; some rows get unusable texts.
RAW_LON = (
    "CASE WHEN {id} % 97 = 0 THEN 'abc' WHEN {id} % 89 = 0 THEN '' WHEN {id} % 83 = 0 THEN 'nan'"
    " WHEN {id} % 10 = 3 THEN concat(' -104.', lpad(CAST(({id} * 7919) % 10007 AS STRING), 5, '0'), ' ')"
    " ELSE concat('-104.', lpad(CAST(({id} * 7919) % 10007 AS STRING), 5, '0')) END"
)
RAW_LAT = "concat('39.', lpad(CAST(({id} * 6101) % 10009 AS STRING), 5, '0'))"
# Some ids repeat the id before them.
RAW_ID = "CAST({id} - CASE WHEN {id} % 10 = 1 THEN 1 ELSE 0 END AS STRING)"


def raw_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash export with four time formats, old rows, bad cells and repeated ids."""
    events = _read(spark, sf_dir, "events").selectExpr(
        "*", "CASE WHEN event_id % 13 = 0 THEN ts - make_ym_interval(6) ELSE ts END AS t"
    )
    return events.selectExpr(
        f"{RAW_ID.format(id='event_id')} AS incident_id",
        f"{RAW_LON.format(id='event_id')} AS geo_lon",
        f"{RAW_LAT.format(id='event_id')} AS geo_lat",
        "CASE event_id % 4 WHEN 0 THEN date_format(t, 'yyyy-MM-dd HH:mm:ss')"
        " WHEN 1 THEN date_format(t, 'MM/dd/yyyy hh:mm:ss a')"
        " WHEN 2 THEN concat(date_format(t, 'yyyy-MM-dd'), 'T', date_format(t, 'HH:mm:ss'), '+02:00')"
        " ELSE CASE WHEN event_id % 100 = 3 THEN 'zz' ELSE date_format(t, 'yyyy/MM/dd HH:mm') END END"
        " AS first_occurrence_date",
        "CASE WHEN event_type = 'error' THEN '1.9' WHEN event_id % 7 = 0 THEN 'x' ELSE '0' END AS FATALITIES",
        "CASE WHEN event_type = 'purchase' THEN ' 2 ' WHEN event_id % 5 = 0 THEN '' ELSE '-1.5' END AS SERIOUSLY_INJURED",
        "event_id AS _position",
    )


def raw_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hazard export over the whole document texts."""
    return (
        hazard_raw(spark, sf_dir)
        .withColumn("id", F.col("hazard_id").cast("bigint"))
        .selectExpr(
            f"{RAW_ID.format(id='id')} AS `OBJECT ID`",
            f"{RAW_LON.format(id='id')} AS Longitude",
            f"{RAW_LAT.format(id='id')} AS Latitude",
            "raw_status AS `Case Status`",
            "CASE WHEN id % 17 = 0 THEN '' ELSE date_format(opened_at, 'MM/dd/yyyy hh:mm:ss a') END AS `Case Created dttm`",
            "kind AS Type",
            "topic AS Topic",
            "summary AS `Case Summary`",
            "id AS _position",
        )
    )


def raw_bikeway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bikeway export: state-plane feet, one or two parts, some rows without a line."""
    k = "s_suppkey"

    def pair(dx, dy):
        return f"CAST(3140000 + ({k} * 7919) % 10007 + {dx} AS STRING), ' ', CAST(1690000 + ({k} * 6101) % 10009 + {dy} AS STRING)"

    one = f"{pair(0, 0)}, ', ', {pair(500, 250)}, ',', {pair(900, 700)}"
    two = f"{pair(1500, 0)}, ',', {pair(1900, 300)}"
    return _read(spark, sf_dir, "supplier").selectExpr(
        f"{RAW_ID.format(id=k)} AS FID",
        "concat(' ', upper(CASE s_nationkey % 3 WHEN 0 THEN 'protected' WHEN 1 THEN 'trail' ELSE 'shared' END)) AS fac_type",
        "CASE s_nationkey % 2 WHEN 0 THEN 'existing ' ELSE '' END AS status",
        f"CASE WHEN {k} % 9 = 4 THEN 'POINT(1 2)' WHEN {k} % 9 = 5 THEN '' "
        f"WHEN {k} % 2 = 0 THEN concat('LINESTRING (', {one}, ')') "
        f"ELSE concat('multilinestring((', {one}, '), (', {two}, '))') END AS WKT",
        f"{k} AS _position",
    )


def route_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One routing answer per order with three routes, some of them without coordinates."""

    def coordinates(shift: str, count: int) -> str:
        points = ", ".join(
            f"array({vertex_lon('o_custkey', 'o_orderkey', str(j))}, {vertex_lat('o_custkey', 'o_orderkey', str(j))} + {shift})"
            for j in range(count)
        )
        return f"array({points})"

    def one(coords: str, distance: str, legs: str) -> str:
        return (
            f"named_struct('geometry', named_struct('type', 'LineString', 'coordinates', {coords}),"
            f" 'distance', {distance}, 'duration', o_totalprice / 2e2, 'weight', 1e0, 'weight_name', 'routability',"
            f" 'legs', {legs})"
        )

    leg = "named_struct('distance', {d}, 'duration', 1e0, 'weight', 1e0, 'summary', '')"
    no_legs = "CAST(NULL AS ARRAY<STRUCT<distance: DOUBLE, duration: DOUBLE, weight: DOUBLE, summary: STRING>>)"
    some_legs = f"array({leg.format(d='o_totalprice / 1e2')}, {leg.format(d='CAST(NULL AS DOUBLE)')})"
    gap = f"CASE WHEN o_orderkey % 4 = 0 THEN CAST(array() AS ARRAY<ARRAY<DOUBLE>>) ELSE {coordinates('1e-3', 3)} END"
    routes = ", ".join(
        [
            one(coordinates("0e0", 6), "o_totalprice / 5e1", no_legs),
            one(gap, "CAST(NULL AS DOUBLE)", some_legs),
            one(coordinates("2e-3", 4), "CAST(NULL AS DOUBLE)", no_legs),
        ]
    )
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", f"array({routes}) AS routes")
