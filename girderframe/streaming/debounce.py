"""Debounce: one row per burst of events of a key, carrying the last event."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def debounce(events: DataFrame, key: str, time: str, order: str, quiet_seconds: float, block_seconds: float | None = None) -> DataFrame:
    """Last event of each burst; a burst ends when nothing follows within the quiet time.

    An event is last when the next event of its key comes later than the quiet time. The
    next event is looked up inside blocks of time, so a key with very many events is spread
    over tasks; the last event of a block looks at the first one of the following block,
    which is far enough because a block is longer than the quiet time.
    """
    quiet = int(quiet_seconds * 1_000_000)
    width = int((block_seconds or max(quiet_seconds * 1000, 3600)) * 1_000_000)
    if width < quiet:
        raise ValueError("a block must be longer than the quiet time")
    timed = events.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_block", F.floor(F.col("_us") / width))
    firsts = timed.groupBy(key, (F.col("_block") - 1).alias("_block")).agg(F.min("_us").alias("_following"))
    inside = Window.partitionBy(key, "_block").orderBy("_us", order)
    following = F.coalesce(F.lead("_us").over(inside), F.col("_following"))
    return (
        timed.join(firsts, [key, "_block"], "left")
        .withColumn("_next", following)
        .filter(F.col("_next").isNull() | (F.col("_next") - F.col("_us") > quiet))
        .select(*events.columns)
    )


def debounce_stream(events: DataFrame, key: str, time: str, order: str, quiet: str, lateness: str) -> DataFrame:
    """The same on a stream: session windows with the last event of each session, given out once it is over.

    A session is over when the watermark, the latest time seen less ``lateness``, has passed its quiet time; later
    events that would still belong to it are dropped.
    """
    others = [c for c in events.columns if c not in (key, time)]
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.session_window(time, quiet), key)
        .agg(F.max_by(F.struct(time, *others), F.struct(time, order)).alias("_last"), F.count(F.lit(1)).alias("events"))
        .select(key, "_last.*", "events")
    )


def run_debounce(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    *,
    key: str,
    time: str,
    order: str,
    quiet_seconds: float,
    lateness: str,
    files_per_batch: int | None = None,
) -> int:
    """Debounce all Parquet files that have come to ``source`` since the last run; returns the batches of this run.

    Each run takes what is there and stops. Open sessions, the watermark and the files seen live in ``checkpoint``,
    so a run that breaks off goes on where it was and gives no row twice. Rows that hold a time and no ``order``
    only move the watermark on.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # An event at just the quiet time still belongs to a session. The test on what a session holds, not on its
    # key, keeps rows of a time alone in the stream up to the watermark.
    gap = f"{int(quiet_seconds * 1_000_000) + 1} microseconds"
    last = debounce_stream(reader.parquet(source), key, time, order, gap, lateness).filter(F.col(order).isNotNull())
    query = last.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return len({p["batchId"] for p in query.recentProgress})


def close_sessions(spark: SparkSession, source: str, schema: StructType, time: str, at: datetime) -> None:
    """Add a row that holds nothing but a time to ``source``: sessions that are over by then, less the lateness, are given out."""
    row = [at if f.name == time else None for f in schema.fields]
    spark.createDataFrame([tuple(row)], StructType([StructField(f.name, f.dataType) for f in schema.fields])).coalesce(1).write.mode("append").parquet(source)
