"""Route documents: JSON answers of a routing service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.fixed_values import DEFAULT_MODE, MODES
from kerbline.functions.geometry import vertices_of

ROUTES_TYPE = (
    "array<struct<geometry:struct<type:string,coordinates:array<array<double>>>,"
    "distance:double,duration:double,weight:double,weight_name:string,"
    "legs:array<struct<distance:double,duration:double,weight:double,summary:string>>>>"
)
DOCUMENT_SCHEMA = (
    f"code string, routes {ROUTES_TYPE}, "
    "waypoints array<struct<hint:string,location:array<double>,name:string,distance:double>>"
)


def read_route_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per document, with its file name and the travel mode named in it."""
    mode = F.regexp_extract(F.col("file"), "(" + "|".join(MODES) + ")", 1)
    return (
        spark.read.schema(DOCUMENT_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("file"))
        .withColumn("mode", F.when(mode == "", DEFAULT_MODE).otherwise(mode))
    )


def explode_routes(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per route with its place in the document as ``index``."""
    return documents.select(*keep, F.posexplode("routes").alias("index", "r")).select(
        *keep,
        "index",
        F.coalesce(vertices_of(F.col("r.geometry.coordinates")), F.array().cast("array<struct<lon:double,lat:double>>")).alias(
            "vertices"
        ),
        F.col("r.distance").alias("distance"),
        F.col("r.duration").alias("duration"),
        F.col("r.legs").alias("legs"),
    )
