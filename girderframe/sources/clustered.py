"""Stored tables whose layout saves work: boxes along a space-filling curve, property rows bucketed by object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girderframe.session import parts_for

#: Bits of the curve for each axis.
AXIS_BITS = 20


def _spread(bits: Column) -> Column:
    """Put two zero bits behind each of the lower 21 bits (fixed masks of bit interleaving)."""
    x = bits
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve_key(geometry: DataFrame) -> Column:
    """Place of a box's centre on the curve that interleaves the bits of its coordinates; a box without place is 0."""
    centre = {a: (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"}
    low_high = geometry.agg(*[f(c).alias(f"{n}_{a}") for a, c in centre.items() for n, f in (("low", F.min), ("high", F.max))]).first()
    key = F.lit(0).cast("long")
    for shift, (a, c) in enumerate(centre.items()):
        low, high = low_high[f"low_{a}"], low_high[f"high_{a}"]
        if low is None or high <= low:
            continue
        cell = F.floor((c - low) / (high - low) * ((1 << AXIS_BITS) - 1)).cast("long")
        key = key.bitwiseOR(F.shiftleft(_spread(F.coalesce(cell, F.lit(0))), shift))
    return key


def write_boxes(geometry: DataFrame, path: str, files: int = 64, rows_per_file: int = 1_000_000) -> None:
    """Boxes in the order of the curve, so that a window or a neighbourhood lies in few files and row groups.

    Parquet keeps the smallest and largest corner of each row group, and the range tests of a window skip the
    groups outside it.
    """
    keyed = geometry.withColumn("_curve", curve_key(geometry))
    ordered = keyed.repartitionByRange(files, "_curve", "object_id").sortWithinPartitions("_curve", "object_id").drop("_curve")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def save_by_object(properties: DataFrame, name: str, path: str, buckets: int = 64, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Property rows as an external table bucketed by object and sorted by object and ``seq``; returns the table.

    Work on single objects (grouping, first and last rows, the merge with geometry) then needs no exchange of
    the property rows. There are at least ``buckets``, and more for a large table, since one task sorts, writes and
    later reads a whole bucket. An object with very many rows stays in one bucket.
    """
    spark: SparkSession = properties.sparkSession
    buckets = parts_for(properties, rows_per_bucket, buckets)
    writer = properties.repartition(buckets, "object_id").write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "object_id").sortBy("object_id", "seq").saveAsTable(name)
    return spark.table(name)
