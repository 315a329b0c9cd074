"""Stored tables that are updated in place, bucket by bucket.

A table is dealt into folders by the hash of one column. An update reads the buckets that it can change, works out
their new rows, stores these in the shared folder and only then puts them in the place of the old ones, so a run
that breaks off can be repeated, and repeating a run that did not changes nothing. The counts of an update are
taken while its rows are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girderframe.operators import schedule as sched
from girderframe.session import stored_counting

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketTable:
    """A Parquet folder with one sub-folder for each bucket of ``key``; ``schema`` leaves the bucket out."""

    path: str
    key: str
    schema: str
    buckets: int = 64

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The rows; with ``buckets`` only those folders are listed in the plan."""
        rows = spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return (rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def bucket_of(self, spark: SparkSession, value: str | None) -> int:
        return spark.range(1).select(self.bucket(F.lit(value).cast("string"))).first()[0]


def create_table(rows: DataFrame, path: str, key: str, buckets: int = 64) -> BucketTable:
    """Write ``rows`` as a table that is dealt out by ``key``; a table that lies there goes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = BucketTable(path, key, schema, buckets)
    rows.withColumn(BUCKET, table.bucket(F.col(key))).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return table


def replace_bucket(table: BucketTable, rows: DataFrame, bucket: int, counted: Column) -> int:
    """Put ``rows`` in the place of a bucket's rows; returns for how many of them ``counted`` holds."""
    spark = rows.sparkSession
    new, total, hits = stored_counting(rows, "bucket", counted)
    if total:
        numbered = new.withColumn(BUCKET, F.lit(bucket))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(table.path)
    else:
        # A bucket without rows is a folder that is gone.
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table.path}/{BUCKET}={bucket}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return hits


def write_back(table: BucketTable, spark: SparkSession, matched: DataFrame, category: str, overwrite: bool = True) -> int:
    """Write the schedule fields of matched rows under ``category`` of a property table dealt out by category.

    Returns the number of rows that the category then has. Only the category's bucket is read in full and written;
    new rows are numbered behind all rows of other categories, so a second run gives the same table.
    """
    bucket = table.bucket_of(spark, category)
    behind = sched.last_number(table.read(spark), category)
    rows = sched.write_back(table.read(spark, [bucket]), matched, category, overwrite, behind=behind)
    return replace_bucket(table, rows, bucket, F.coalesce(F.col("category") == category, F.lit(False)))


def remove_category(table: BucketTable, spark: SparkSession, category: str) -> int:
    """Remove all rows of ``category`` from a property table dealt out by category; returns how many it had."""
    return _remove(table, spark, "category", category)


def clear_root(table: BucketTable, spark: SparkSession, root: str) -> int:
    """Remove the outputs of a root folder from a table dealt out by ``root_folder``; returns how many there were."""
    return _remove(table, spark, "root_folder", root)


def _remove(table: BucketTable, spark: SparkSession, column: str, value: str) -> int:
    if table.key != column:
        raise ValueError(f"the table is dealt out by {table.key}, not by {column}")
    bucket = table.bucket_of(spark, value)
    old = table.read(spark, [bucket])
    own = F.coalesce(F.col(column) == value, F.lit(False))
    removed = old.agg(F.count_if(own)).first()[0]
    if removed:
        replace_bucket(table, old.filter(~own), bucket, F.lit(True))
    return removed
