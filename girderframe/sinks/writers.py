"""Writers: CSV, JSON and Turtle folders, one part file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girderframe.functions.rdf import GEOMETRY_PREFIXES, SPATIAL_PREFIXES
from girderframe.functions.text import csv_cell
from girderframe.operators import props
from girderframe.session import stored, stored_counting
from girderframe.sinks import frames
from girderframe.sinks.nested import nested_json_lines

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite") -> None:
    """CSV with doubled quotes; cells with a comma, quote or line break are quoted."""
    df.write.mode(mode).options(**CSV_OPTIONS, quoteAll=str(quote_all).lower()).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, order: list[str], text: str, path: str, mode: str = "overwrite") -> None:
    """Text lines in a global order: part files follow each other in that order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode(mode).text(path)


def write_hierarchy(records: DataFrame, path: str, include_unit: bool = True) -> None:
    write_csv(frames.hierarchy(records, include_unit), path)


def write_nested_json(records: DataFrame, path: str, tree: DataFrame | None = None) -> None:
    """Nested tree; the part files in order, inside ``[`` and ``]``, are one JSON array."""
    write_lines(nested_json_lines(records, tree), ["key", "kind", "no"], "text", path)


def write_wide(records: DataFrame, path: str, block_columns: int = 1000) -> int:
    """One row per object and one column per property, at any width; returns the number of blocks.

    The columns are cut into blocks of ``block_columns``. ``rows/block=k`` holds CSV lines without a header, one for
    every object, under the object's id; the first block also has parent, level and name. ``manifest`` names
    the columns of each block in order, and ``headers`` has them as CSV lines.
    """
    lines, columns = props.wide_lines(records, block_columns)
    identity = [c for c in ("parent_id", "level", "display_name") if c in records.columns]
    named = columns.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "name"))), lambda c: c["name"]).alias("columns"))
    first = records.sparkSession.createDataFrame([(0, [])], "block int, columns array<string>")
    named = named.unionByName(first).groupBy("block").agg(F.max_by("columns", F.size("columns")).alias("columns"))
    own = F.when(F.col("block") == 0, F.array(*map(F.lit, ["object_id", *identity]))).otherwise(F.array(F.lit("object_id")))
    manifest = stored(named.select("block", own.alias("identity"), "columns"), "manifest")
    write_json(manifest, f"{path}/manifest")
    header = F.array_join(F.transform(F.concat("identity", "columns"), csv_cell), ",")
    manifest.select(header.alias("line"), "block").write.mode("overwrite").partitionBy("block").text(f"{path}/headers")
    lines.select("line", "block").write.mode("overwrite").partitionBy("block").text(f"{path}/rows")
    return manifest.count()


def read_wide(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """(property columns, rows) of the blocks of a wide export, in order; empty cells are empty texts."""
    manifest = spark.read.schema("block int, identity array<string>, columns array<string>").json(f"{path}/manifest")
    blocks = []
    for row in manifest.orderBy("block").collect():
        names = [*row["identity"], *row["columns"]]
        # Columns are numbered while they are read, for names may hold any character.
        schema = ", ".join(f"_{k} string" for k in range(len(names)))
        cells = spark.read.schema(schema).options(**{**CSV_OPTIONS, "header": "false"}).csv(f"{path}/rows/block={row['block']}")
        blocks.append((list(row["columns"]), cells.na.fill("").toDF(*names)))
    return blocks


def read_wide_cells(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, name, value) of all filled property cells of a wide export; the plan does not grow with its blocks."""
    manifest = spark.read.schema("block int, identity array<string>, columns array<string>").json(f"{path}/manifest")
    width = manifest.agg(F.max(F.size("identity") + F.size("columns"))).first()[0]
    schema = ", ".join([*[f"_{k} string" for k in range(width)], "block int"])
    lines = spark.read.schema(schema).options(**{**CSV_OPTIONS, "header": "false"}).csv(f"{path}/rows")
    # The first cell is the object's id; other identity cells have no name in the manifest's columns.
    cells = lines.select("block", F.col("_0").alias("object_id"), F.posexplode(F.array(*[f"_{k}" for k in range(width)])).alias("place", "value"))
    names = manifest.select("block", F.size("identity").alias("_own"), F.posexplode("columns").alias("_no", "name"))
    places = names.select("block", (F.col("_own") + F.col("_no")).alias("place"), "name")
    return cells.filter("value <> ''").join(places.hint("merge"), ["block", "place"]).select("object_id", "name", "value")


def write_long(records: DataFrame, path: str) -> None:
    """One row per object and property, with the last value."""
    last = props.last_rows(records, ["object_id", "category", "property_name"])
    write_csv(last.select("object_id", "category", "property_name", "property_value"), path)


def write_dual(records: DataFrame, path: str) -> DataFrame:
    """Raw and refined property CSV; returns the category statistics."""
    kept = records.persist()
    try:
        write_csv(frames.raw_properties(kept), f"{path}/raw")
        write_csv(frames.refined_properties(kept), f"{path}/refined")
    finally:
        kept.unpersist()
    return props.category_rows(records)


def write_manifest(geometry: DataFrame, path: str, project: str, exported_at: str) -> None:
    """Objects as JSON lines and the metadata beside them."""
    frames.manifest_objects(geometry).select("json").write.mode("overwrite").text(f"{path}/objects")
    write_json(frames.manifest_metadata(geometry, project, exported_at), f"{path}/metadata")


def write_adjacency(named_edges: DataFrame, path: str) -> bool:
    """Edges as CSV; nothing is written for no edges."""
    if named_edges.isEmpty():
        return False
    write_csv(frames.adjacency(named_edges), path)
    return True


def write_groups(stats: DataFrame, groups: DataFrame, path: str) -> bool:
    if stats.isEmpty():
        return False
    write_csv(frames.connected_groups(stats, groups), path)
    return True


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str], mode: str = "overwrite") -> None:
    """Triples one per line in ``triples``, the prefix lines in ``prefixes``.

    With ``append`` the triples join those already there.
    """
    spark = triples.sparkSession
    head = [(f"@prefix {name}: <{uri}> .",) for name, uri in prefixes.items()]
    spark.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/prefixes")
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    triples.select(line.alias("value")).write.mode(mode).text(f"{path}/triples")


def merge_turtle(triples: DataFrame, path: str, prefixes: dict[str, str], buckets: int = 64) -> int:
    """Add triples to a Turtle folder that is laid out by the hash of the subject; returns how many were new.

    A triple that the folder holds is not written again, so a repeated run adds nothing. New triples meet only the
    buckets of their own subjects.
    """
    spark = triples.sparkSession
    folder = f"{path}/triples"
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    dealt = triples.select(line.alias("value"), F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int").alias("_bucket")).distinct()
    dealt = stored(dealt, "triples")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        # At most ``buckets`` numbers.
        touched = [r["_bucket"] for r in dealt.select("_bucket").distinct().collect()]
        held = spark.read.schema("value string, _bucket int").text(folder).filter(F.col("_bucket").isin(touched))
        dealt = dealt.join(held, ["_bucket", "value"], "left_anti")
    else:
        head = [(f"@prefix {name}: <{uri}> .",) for name, uri in prefixes.items()]
        spark.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/prefixes")
    new, added, _ = stored_counting(dealt, "new", F.lit(True))
    if added:
        # Triples of a common subject are spread over several files of its bucket.
        new.repartition("_bucket", F.pmod(F.xxhash64("value"), F.lit(8))).write.mode("append").partitionBy("_bucket").text(folder)
    return added


def write_geometry_turtle(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_turtle(triples, path, GEOMETRY_PREFIXES, mode)


def write_spatial_turtle(triples: DataFrame, path: str) -> None:
    write_turtle(triples, path, SPATIAL_PREFIXES)


def write_validation(validation: DataFrame, path: str) -> None:
    write_csv(frames.validation(validation), path)


def write_report(report: DataFrame, issues: DataFrame, path: str) -> None:
    """Quality report as JSON lines and as ordered text, errors before warnings."""
    write_json(report, f"{path}/summary")
    frames.issue_json(issues).select("json").write.mode("overwrite").text(f"{path}/issues")
    write_lines(frames.report_lines(report, issues), ["section", "object_id", "detail"], "line", f"{path}/text")
