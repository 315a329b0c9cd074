"""Queries over stored layouts: the text index, boxes along a curve, properties bucketed by object."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import model
from checks.registry import query
from checks.written import _path, same_as
from girderframe.functions.boxes import Box
from girderframe.operators import props, text_index, unified
from girderframe.sources import clustered, schedule_csv
from girderframe.sinks import writers
from girderframe.functions.display import with_parsed

assert model  # its SQL is used again here

_SEARCHED = ["display_name", "property_value", "property_name", "sys_path"]


def _indexed(fx) -> str:
    path = _path(fx, "index")
    text_index.build(fx("fx_records"), "seq", _SEARCHED, path)
    return path


@same_as("C04_indexed_search", "C04_global_search")
def indexed_search(fx):
    """A query of two letters, which no trigram helps."""
    return text_index.search(fx.spark, _indexed(fx), "99").rows.select(F.col("key").alias("seq"))


_ASKED = "Element 14"


@query("C04_indexed_long_query", f"""
SELECT seq FROM {{fx_records}} WHERE contains(lower(display_name),'{_ASKED.lower()}') OR contains(lower(property_value),'{_ASKED.lower()}') OR contains(lower(property_name),'{_ASKED.lower()}') OR contains(lower(sys_path),'{_ASKED.lower()}')""")
def indexed_long_query(fx):
    return text_index.search(fx.spark, _indexed(fx), _ASKED).rows.select(F.col("key").alias("seq"))


@query("C04_index_candidates", f"""
WITH t AS (SELECT DISTINCT lower(text) AS low, text FROM (SELECT unnest([display_name, property_value, property_name, sys_path]) AS text FROM {{fx_records}}) WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT substr('{_ASKED.lower()}', k, 3) AS gram FROM (SELECT unnest(range(1, {len(_ASKED) - 1})) AS k)),
rarest AS (SELECT gram FROM (SELECT gram, (SELECT count(*) FROM t WHERE contains(low, gram)) AS n FROM asked) ORDER BY n, gram LIMIT 4),
c AS (SELECT low, text FROM t WHERE (SELECT count(*) FROM rarest WHERE contains(low, gram)) = (SELECT count(*) FROM rarest))
SELECT (SELECT count(*) FROM t) AS all_texts, count(*) AS candidates, count(*) FILTER (contains(low, '{_ASKED.lower()}')) AS texts FROM c""")
def index_candidates(fx):
    """How many of all texts a search looks at, and how many of them hold the query."""
    path = _indexed(fx)
    found = text_index.search(fx.spark, path, _ASKED)
    total = fx.spark.read.parquet(f"{path}/texts")
    return total.agg(F.count(F.lit(1)).alias("all_texts")).withColumns({"candidates": F.lit(found.candidates).cast("long"), "texts": F.lit(found.texts).cast("long")})


@same_as("C05_indexed_filter", "C05_table_filter")
def indexed_filter(fx):
    path = _path(fx, "index")
    text_index.build(fx("supplier"), "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"], path)
    key = F.col("key").alias("s_suppkey")
    anywhere = text_index.search(fx.spark, path, "4").rows.select(key, F.lit("any").alias("scope"))
    return anywhere.unionByName(text_index.search(fx.spark, path, "4", "s_name").rows.select(key, F.lit("name").alias("scope")))


@same_as("C06_indexed_property", "C06_exact_property_search")
def indexed_property(fx):
    keys = text_index.lookup(fx.spark, _indexed(fx), "2.5 m", "property_value").rows.select(F.col("key").alias("seq"))
    return props.find_by_property(fx("fx_records").join(keys, "seq", "left_semi"), "Dimensions", "Height", "2.5 m")


@same_as("C12_clustered_window", "C12_spatial_window")
def clustered_window(fx):
    path = _path(fx, "boxes")
    clustered.write_boxes(fx("fx_geometry"), path, files=16)
    inside = props.in_window(fx.spark.read.parquet(path), 0, 0, 40, 100)
    return inside.select("object_id", Box.of().volume().alias("volume")).orderBy(F.desc("volume"), "object_id")


def _by_object(fx):
    return clustered.save_by_object(fx("fx_records"), f"by_object_{uuid.uuid4().hex}", _path(fx, "bucketed"), 8)


@same_as("G02_bucketed_first_row", "G02_first_row")
def bucketed_first(fx):
    return props.first_rows(_by_object(fx)).select("object_id", "property_name", "property_value", "seq")


@same_as("G03_bucketed_last_write", "G03_last_write")
def bucketed_last(fx):
    return props.last_rows(_by_object(fx), ["object_id", "category"]).select("object_id", "category", "property_name", "seq")


@same_as("D01_bucketed_merge", "D01_unified_merge")
def bucketed_merge(fx):
    return unified.merge(_by_object(fx), fx("fx_mesh_geometry")).select(
        "object_id", "parent_id", "level", "display_name", "object_category", "hierarchy_path", "property_count", "has_box",
        "min_x", "max_z", "centroid_y", "volume", "has_mesh", "mesh_quality", "vertex_count",
    )


@query("A02_file_errors", """
SELECT 'empty' AS file, 'the file is empty' AS error UNION ALL SELECT 'no sync id', 'a sync id column is required' UNION ALL SELECT 'good', 'rows: '||CAST(count(*) AS STRING) FROM {supplier}""")
def file_errors(fx):
    """What reading says of three schedule files: without lines, without the required column, and good."""
    names = fx("supplier").select(F.col("s_suppkey").cast("string").alias("SyncID"), F.col("s_name").alias("TaskName"))
    files = {"empty": fx("supplier").filter("false").select(F.lit("").alias("value")), "no sync id": names.select("TaskName"), "good": names}
    said = []
    for name, rows in files.items():
        path = _path(fx, "errors")
        if name == "empty":
            rows.write.text(path)
        else:
            writers.write_csv(rows, path)
        try:
            said.append((name, f"rows: {schedule_csv.read_schedule(fx.spark, path).count()}"))
        except schedule_csv.ScheduleFileError as e:
            said.append((name, str(e)))
    return fx.spark.createDataFrame(said, "file string, error string")


@query("S06_property_json", "SELECT object_id, category, property_name, property_value, raw_value, data_type FROM {fx_parsed}")
def property_json(fx):
    """Parsed property rows written as JSON lines and read back."""
    path = _path(fx, "json")
    rows = with_parsed(fx("fx_records"))
    writers.write_json(rows, path)
    return fx.spark.read.schema(rows.schema).json(path).select("object_id", "category", "property_name", "property_value", "raw_value", "data_type")
