"""Files written and read back, and rule documents loaded and used."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import model, plan, scalars
from checks.registry import QUERIES, Query, query
from girderframe.functions import classify
from girderframe.functions.display import with_parsed
from girderframe.operators import precedence, triples
from girderframe.session import work_dir
from girderframe.sinks import frames, updates, writers
from girderframe.sources import rules, schedule_csv

# The modules whose SQL is used again here must be registered first.
assert model and plan and scalars

_WIDE = """
SELECT object_id, coalesce(max(CASE WHEN property_name='Height' THEN property_value END),'') AS "Dimensions|Height", coalesce(max(CASE WHEN property_name='Length' THEN property_value END),'') AS "Dimensions|Length",
 coalesce(max(CASE WHEN property_name='Id' THEN property_value END),'') AS "Element|Id", coalesce(max(CASE WHEN property_name='Name' THEN property_value END),'') AS "Item|Name", coalesce(max(CASE WHEN property_name='Type' THEN property_value END),'') AS "Item|Type" FROM {fx_records} GROUP BY object_id"""


def _path(fx, name: str) -> str:
    return f"{work_dir(fx.spark)}/girderframe/{name}-{uuid.uuid4().hex}"


def _back(fx, path: str):
    """A written CSV with empty cells as empty texts."""
    rows = fx.spark.read.options(**writers.CSV_OPTIONS).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def same_as(name: str, other: str):
    """Register a query that must equal the SQL of ``other``."""

    def wrap(build):
        QUERIES[name] = Query(build, QUERIES[other].sql)
        return build

    return wrap


@same_as("S02_hierarchy_json", "S01_hierarchy_frame")
def hierarchy_json(fx):
    path = _path(fx, "json")
    frame = frames.hierarchy(with_parsed(fx("fx_records")))
    writers.write_json(frame, path)
    return fx.spark.read.schema(frame.schema).json(path)


@same_as("S07_dual_refined", "S05_refined_property_frame")
def dual_refined(fx):
    path = _path(fx, "dual")
    writers.write_dual(fx("fx_records"), path)
    return _back(fx, f"{path}/refined")


@same_as("S07_dual_raw", "S04_raw_property_frame")
def dual_raw(fx):
    path = _path(fx, "dual")
    writers.write_dual(fx("fx_records"), path)
    return _back(fx, f"{path}/raw")


@query("S08_wide_file", _WIDE)
def wide_file(fx):
    path = _path(fx, "wide")
    writers.write_wide(fx("fx_records"), path)
    [(_, rows)] = writers.read_wide(fx.spark, path)
    return rows.drop("parent_id", "level", "display_name")


@query("S08_long_fallback", "SELECT object_id, category, property_name, property_value FROM {fx_records}")
def long_fallback(fx):
    path = _path(fx, "wide")
    writers.write_long(fx("fx_records"), path)
    return _back(fx, path)


def _long(cells):
    """The property rows of a wide export: every filled cell with its column's name."""
    split = F.split("name", r"\|", 2)
    return cells.select("object_id", split[0].alias("category"), split[1].alias("property_name"), F.col("value").alias("property_value"))


@query("S08_wide_three_columns", "SELECT object_id, category, property_name, property_value FROM {fx_records} WHERE property_value<>''")
def wide_three_columns(fx):
    """The same form in blocks of three columns."""
    path = _path(fx, "wide")
    writers.write_wide(fx("fx_records"), path, block_columns=3)
    return _long(writers.read_wide_cells(fx.spark, path))


@query("S08_very_wide", """
SELECT 'S:'||CAST(l_suppkey AS STRING) AS object_id, 'Part '||CAST(l_partkey AS STRING) AS category, 'Line '||CAST(l_linenumber AS STRING) AS property_name, CAST(CAST(max_by(l_quantity, l_orderkey) AS INT) AS STRING) AS property_value
FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_linenumber""")
def very_wide(fx):
    """Some ten thousand columns: one for every part and line number that a supplier delivers."""
    rows = fx("lineitem").select(
        F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("object_id"), F.lit("").alias("parent_id"), F.lit(1).alias("level"), F.lit("x").alias("display_name"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("category"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("property_name"),
        F.col("l_quantity").cast("int").cast("string").alias("property_value"), F.col("l_orderkey").alias("seq"),
    )
    path = _path(fx, "wide")
    writers.write_wide(rows, path, block_columns=1000)
    return _long(writers.read_wide_cells(fx.spark, path))


@same_as("D15_write_back_table", "D15_write_back")
def write_back_table(fx):
    """Written back twice: the second run changes nothing."""
    rows = fx("fx_records").select("object_id", "category", "property_name", "property_value", "seq")
    table = updates.create_table(rows, _path(fx, "table"), "category", 8)
    counts = [updates.write_back(table, fx.spark, plan.matched(fx), "Item") for _ in range(2)]
    back = table.read(fx.spark)
    # Both runs count the rows of the category alike, and all numbers differ.
    numbers = back.agg((F.count(F.lit(1)) - F.count_distinct("seq")).alias("again")).first()["again"]
    if counts[0] != counts[1] or numbers:
        raise AssertionError(f"{counts} rows, {numbers} numbers twice")
    return back.drop("seq")


@same_as("D16_remove_category_table", "D16_remove_category")
def remove_category_table(fx):
    rows = fx("fx_records").select("object_id", "category", "property_name", "property_value", "seq")
    table = updates.create_table(rows, _path(fx, "table"), "category", 8)
    for _ in range(2):
        updates.remove_category(table, fx.spark, "Dimensions")
    return table.read(fx.spark).select("seq")


@query("L10_clear_table", "SELECT seq, CAST(0 AS BIGINT) AS deleted FROM {fx_schedule} WHERE seq%3<>0 UNION ALL SELECT -1, count(*) FROM {fx_schedule} WHERE seq%3=0 UNION ALL SELECT -2, 0")
def clear_table(fx):
    """The number that each of two runs removes, and the rows left in the stored table."""
    rows = fx("fx_schedule").select("seq", F.when(F.col("seq") % 3 == 0, "AWP 4D Tasks").otherwise("Other").alias("root_folder"))
    table = updates.create_table(rows, _path(fx, "table"), "root_folder", 8)
    counts = [(-1 - k, updates.clear_root(table, fx.spark, "AWP 4D Tasks")) for k in range(2)]
    left = table.read(fx.spark).select("seq", F.lit(0).cast("bigint").alias("deleted"))
    return left.unionByName(fx.spark.createDataFrame(counts, "seq bigint, deleted bigint"))


@query("S14_merged_triples", "SELECT 'bso:Object_'||object_id||' bso:category \"'||category||'\" .' AS value FROM {fx_geometry} WHERE category='Pipe' OR seq%2=0")
def merged_triples(fx):
    """Half of the objects, then all pipes, then both again: every triple is there once."""
    path = _path(fx, "ttl")
    all_triples = triples.geometry_triples(fx("fx_geometry")).filter("p = 'bso:category'")
    even = triples.geometry_triples(fx("fx_geometry").filter("seq % 2 = 0")).filter("p = 'bso:category'")
    pipes = all_triples.filter(F.col("o") == F.lit('"Pipe"'))
    for part in (even, pipes, even, pipes):
        writers.merge_turtle(part, path, {"bso": "http://example.org/bso#"})
    return fx.spark.read.schema("value string, _bucket int").text(f"{path}/triples").select("value")


def _mixed_folder(fx, first: str, second: str):
    """Suppliers in two files: id, name in one encoding, and name, id in another."""
    path = _path(fx, "mixed")
    schedule_csv._allow_encoding(fx.spark, "EUC-KR")
    rows = fx("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("공급자 "), "s_name").alias("name"))
    rows.filter("id % 2 = 1").coalesce(1).write.options(**writers.CSV_OPTIONS, encoding=first).mode("append").csv(path)
    rows.filter("id % 2 = 0").select("name", "id").coalesce(1).write.options(**writers.CSV_OPTIONS, encoding=second).mode("append").csv(path)
    return path


_SUPPLIERS = "SELECT CAST(s_suppkey AS STRING) AS id, '공급자 '||s_name AS name FROM {supplier}"


@query("A05_mixed_folder", _SUPPLIERS)
def mixed_folder(fx):
    """Two files of one folder that differ in encoding and in the order of their columns."""
    path = _mixed_folder(fx, "UTF-8", "EUC-KR")
    return schedule_csv.read_table(fx.spark, path).select("id", "name")


@query("A04_mixed_headers", _SUPPLIERS)
def mixed_headers(fx):
    """Two files of one folder that differ in the order of their columns alone."""
    path = _mixed_folder(fx, "UTF-8", "UTF-8")
    return schedule_csv.read_table(fx.spark, path).select("id", "name")


@query("A01_mixed_schedule", "SELECT CAST(s_suppkey AS STRING) AS sync_id, '공급자 '||s_name AS task_name FROM {supplier}")
def mixed_schedule(fx):
    """Schedule files with headers in two languages, two encodings and two orders."""
    path = _path(fx, "mixed")
    schedule_csv._allow_encoding(fx.spark, "EUC-KR")
    rows = fx("supplier").select(F.col("s_suppkey").cast("string").alias("SyncID"), F.concat(F.lit("공급자 "), "s_name").alias("TaskName"))
    rows.filter("SyncID % 2 = 1").coalesce(1).write.options(**writers.CSV_OPTIONS).mode("append").csv(path)
    korean = rows.filter("SyncID % 2 = 0").select(F.col("TaskName").alias("작업명"), F.col("SyncID").alias("동기화ID"))
    korean.coalesce(1).write.options(**writers.CSV_OPTIONS, encoding="EUC-KR").mode("append").csv(path)
    return schedule_csv.read_schedule(fx.spark, path).select("sync_id", "task_name")


@query("S19_quoted_view", """SELECT '"'||object_id||'","'||property_name||'","'||property_value||'"' AS line FROM {fx_records}""")
def quoted_view(fx):
    path = _path(fx, "quoted")
    writers.write_csv(fx("fx_records").select("object_id", "property_name", "property_value"), path, quote_all=True)
    lines = fx.spark.read.text(path).select(F.col("value").alias("line"))
    return lines.filter(F.col("line") != '"object_id","property_name","property_value"')


@query("A05_encoding", "SELECT CAST(seq AS STRING) AS seq, CASE WHEN task_type_raw='' THEN 'x' ELSE task_type_raw END AS task_type, 'EUC-KR' AS encoding FROM {fx_schedule}")
def encoding(fx):
    """Files in which only some lines hold Korean text."""
    path = _path(fx, "euckr")
    schedule_csv._allow_encoding(fx.spark, "EUC-KR")
    rows = fx("fx_schedule").select(F.col("seq").cast("string").alias("seq"), F.when(F.col("task_type_raw") == "", "x").otherwise(F.col("task_type_raw")).alias("task_type"))
    rows.write.options(**writers.CSV_OPTIONS, encoding="EUC-KR").csv(path)
    found = schedule_csv.detect_encoding(fx.spark, path)
    return schedule_csv.read_table(fx.spark, path, found).withColumn("encoding", F.lit(found))


def _document() -> dict:
    """A rule document that says what the built-in tables say."""
    weights = {theirs: rules.MATCH_WEIGHTS[ours] for theirs, ours in rules.WEIGHT_NAMES.items()}
    patterns = [{"property": f"x:{theirs}", "pattern": rules.AREA_PATTERNS[ours]} for theirs, ours in rules.PATTERN_NAMES.items()]
    return {
        "classification_rules": [{"target_class": f"x:{c}", "keywords": k} for c, k in rules.CLASSIFICATION_RULES],
        "precedence_rules": [{"predecessor_class": a, "successor_class": b, "condition": c, "priority": p} for a, b, c, p in rules.PRECEDENCE_RULES],
        "area_extraction_patterns": patterns,
        "matching_weights": weights,
        "advanced_settings": {"min_match_score": rules.MIN_MATCH_SCORE},
    }


@same_as("A11_loaded_weights", "D19_scored_match")
def loaded_weights(fx):
    made = rules.load_rules(_document())
    return precedence.scored_matches(fx("fx_score_schedule"), fx("fx_score_objects"), made["weights"], made["min_score"])


@same_as("A11_loaded_precedence", "D18_precedence_edges")
def loaded_precedence(fx):
    return precedence.precedence_edges(plan.classified(fx), rules.load_rules(_document())["precedence"])


@query("A11_loaded_patterns", r"SELECT object_id, nullif(regexp_extract(sys_path,'\b(A[0-9]+)\b',1),'') AS area_name, nullif(regexp_extract(sys_path,'\b(U[0-9]+)\b',1),'') AS unit_name FROM {fx_rule_objects}")
def loaded_patterns(fx):
    patterns = rules.load_rules(_document())["area"]
    return fx("fx_rule_objects").select("object_id", *[classify.extract(F.col("sys_path"), f, patterns).alias(f) for f in ("area_name", "unit_name")])
