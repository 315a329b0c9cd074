"""Session settings and lineage cutting."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "girderframe", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and tasks share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


# Folders of the open runs, innermost last.
_RUNS: list[str] = []


@contextlib.contextmanager
def run_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside the block are removed at its end, so results must be used up before.

    The block gets a function that stores a result as ``stored`` does, but so that it outlives the block.
    """
    run, outer = f"run-{uuid.uuid4().hex}", _RUNS[-1] if _RUNS else None
    _RUNS.append(run)
    try:
        yield lambda df, label: stored(df, label, outer or spark.sparkContext.applicationId)
    finally:
        _RUNS.remove(run)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/girderframe/{run}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, run: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the planner the true
    size of the table, so a later join broadcasts it only when it is small.
    """
    spark = df.sparkSession
    run = run or (_RUNS[-1] if _RUNS else spark.sparkContext.applicationId)
    path = f"{work_dir(spark)}/girderframe/{run}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_counting(df: DataFrame, label: str, counted: Column) -> tuple[DataFrame, int, int]:
    """As ``stored``, with the rows and those for which ``counted`` holds, taken while writing."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(counted).alias("hits"))
    table = stored(observed, label)
    return table, seen.get["rows"], seen.get["hits"]


def stored_if_any(df: DataFrame, label: str) -> DataFrame | None:
    """As ``stored``, or ``None`` for an empty frame."""
    table, rows, _ = stored_counting(df, label, F.lit(True))
    return table if rows else None


def spread(table: DataFrame) -> DataFrame:
    """Spread a stored table over all cores when it has fewer partitions than that.

    Large tables have enough partitions of their own and are left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def parts_for(df: DataFrame, rows_per_part: int, least: int = 1) -> int:
    """Partitions that leave each about ``rows_per_part`` rows, so that the memory of a task does not grow with the table."""
    return max(least, -(-df.count() // rows_per_part))
