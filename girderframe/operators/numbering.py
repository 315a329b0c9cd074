"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderframe.session import stored

_LOCAL_BITS = 33


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Number all rows 1..n in ``order``, which must be total.

    The rows are range-partitioned and sorted, stored once with their position inside
    the partition, and shifted by the row counts of the partitions before them. Only
    one row per partition is ever seen by a single task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_pos", F.monotonically_increasing_id()), "numbered").withColumns(
        {"_part": F.shiftright("_pos", _LOCAL_BITS), "_pos": F.col("_pos").bitwiseAND((1 << _LOCAL_BITS) - 1)}
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition of a shuffle: always small.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
