"""Stored property and geometry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girderframe.operators.tree import descendants, extract_records
from girderframe.operators.unified import latest_geometry
from girderframe.schema import GEOMETRY_SCHEMA, PROPERTY_SCHEMA


def read_properties(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(PROPERTY_SCHEMA)
    if format == "csv":
        reader = reader.options(header="true", quote='"', escape='"')
    return reader.format(format).load(path)


def read_geometry(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Usable boxes of a geometry table, one per object."""
    reader = spark.read.schema(GEOMETRY_SCHEMA)
    if format == "csv":
        reader = reader.options(header="true", quote='"', escape='"')
    return latest_geometry(reader.format(format).load(path))


def from_selection(nodes: DataFrame, properties: DataFrame, seeds: DataFrame) -> DataFrame:
    """Property rows of the selected objects and all their descendants."""
    return extract_records(descendants(nodes, seeds), properties)
