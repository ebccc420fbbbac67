"""GeoJSON as lines of features, and feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.functions import geo


def features(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One column, value: each row as a Feature with a LineString."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform(geometry, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def write(df: DataFrame, path: str, geometry: str, properties: list[str]) -> None:
    features(df, geometry, properties).write.mode("overwrite").text(path)


def parse(lines: DataFrame, properties: str) -> DataFrame:
    """Properties, by their schema, and geometry of feature lines(value)."""
    kind = f"properties struct<{properties}>, geometry struct<type:string,coordinates:array<array<double>>>"
    rows = lines.select(F.from_json("value", kind).alias("f"))
    return rows.select("f.properties.*", F.transform("f.geometry.coordinates", lambda c: geo.point(F.get(c, F.lit(0)), F.get(c, F.lit(1)))).alias("geometry"))


def read(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features, one a line."""
    return parse(spark.read.text(path), properties)


def read_collections(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of whole FeatureCollection files."""
    kind = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    return rows.select("f.properties.*", F.transform("f.geometry.coordinates", lambda c: geo.point(F.get(c, F.lit(0)), F.get(c, F.lit(1)))).alias("geometry"))
