"""Quality, verdicts, rules, outputs, debounce and the query registry."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from girderframe.functions import classify, verdicts
from girderframe.functions.display import with_parsed
from girderframe.operators import precedence, props, quality, spatial, triples, unified, validation
from girderframe.plans import jobs
from girderframe.schema import ScheduleOptions
from girderframe.sinks import frames, writers
from girderframe.sources import rules, tables
from girderframe.sources.fixtures import TABLES
from girderframe.streaming.debounce import debounce, debounce_stream
from tests.conftest import SMALL
from tests.test_model import ROWS, text_of


def rows_of(spark, values):
    return with_parsed(
        spark.createDataFrame([(o, "", 0, n, "", c, p, v, i) for i, (o, n, c, p, v) in enumerate(values)], ROWS)
    )


def test_unit_rule_lists_units_in_order_of_appearance(spark):
    rows = rows_of(
        spark,
        [
            ("o", "N", "Dim", "a", "3 ft"), ("o", "N", "Dim", "b", "4 mm"), ("o", "N", "Dim", "c", "5 m"), ("o", "N", "Dim", "d", "2 kg"),
            ("o", "N", "Other", "e", "1 m"), ("p", None, "Dim", "a", "3 파운드"), ("p", None, "Dim", "b", "1 킬로그램"),
        ],
    )
    found = {(r["object_id"], r["category"]): (r["object_name"], r["details"], r["suggestion"]) for r in quality.unit_issues(rows).collect()}
    assert found == {
        ("o", "Dim"): ("N", "length 단위 혼용: ft, mm, m", "단위를 ft로 통일하세요"),
        ("p", "Dim"): ("Unknown", "weight 단위 혼용: lbm, kg", "단위를 lbm로 통일하세요"),
    }


def test_required_and_type_rules(spark):
    rows = rows_of(
        spark,
        [
            ("o", "N", "Item", "NAME", "x"), ("o", "N", "Item", "Type", "  "), ("o", "N", "D", "a", "Double: 5.5"),
            ("o", "N", "D", "b", "Double:5.5"), ("o", "N", "D", "c", "Int32:x"), ("o", "N", "D", "d", "Boolean:TRUE"), ("p", "P", "항목", "이름", "y"),
        ],
    )
    assert {(r["object_id"], r["property_name"]) for r in quality.missing_issues(rows).collect()} == {("o", "Type"), ("p", "유형")}
    # A space after the colon is fine for parsing but not for the type rule.
    assert {r["property_name"] for r in quality.type_issues(rows).collect()} == {"a", "c"}
    total = quality.report(rows).first()
    assert (total["total_objects"], total["warning_count"], total["error_count"], total["valid_objects"]) == (2, 2, 2, 0)


def test_report_equals_the_issue_rows(spark, fx):
    rows = with_parsed(fx("fx_records"))
    issues, total = quality.all_issues(rows), quality.report(rows).first()
    by = {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    bad = issues.select("object_id").distinct().count()
    assert (total["warning_count"], total["error_count"], total["valid_objects"]) == (by["Warning"], by["Error"], total["total_objects"] - bad)


def test_container_limits(spark):
    schema = "object_id string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    boxes = spark.createDataFrame(
        [
            ("half", 0.0, 0.0, 0.0, 2.0, 1.0, 1.0), ("less", 0.0, 0.0, 0.0, 4.0, 1.0, 1.0), ("flat", 0.0, 0.0, 0.0, 1.0, 0.0, 1.0),
            ("c", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0),
        ],
        schema,
    )
    links = spark.createDataFrame([("half", "c"), ("less", "c"), ("flat", "c"), ("none", "c"), ("half", "absent"), ("idle", "absent")], "parent_id string, child_id string")
    got = {r["object_id"]: r["container_status"] for r in validation.containers(links, boxes).collect()}
    assert got == {"half": "skipped_container", "less": "partial_container", "flat": "skipped_container", "none": "skipped_container"}


def test_mesh_status_values(spark):
    cases = {
        (True, True, True, 1, 0, 1, 0): "COM_FAIL", (False, True, True, 1, 0, 1, 0): "HIDDEN", (False, False, False, 0, 0, 0, 0): "PARENT_NO_FRAG",
        (False, False, False, 2, 0, 0, 0): "PARENT_HAS_FRAG", (False, False, True, 0, 0, 0, 0): "NO_FRAGMENTS", (False, False, True, 2, 2, 0, 4): "LINE_ONLY",
        (False, False, True, 2, 2, 0, 0): "EMPTY_TESS", (False, False, True, 2, 1, 0, 0): "TESS_FAIL", (False, False, True, 2, 1, 7, 0): "OK", (False, False, True, 2, 1, -1, 0): "UNKNOWN",
    }
    for row, want in cases.items():
        assert spark.range(1).select(verdicts.mesh_status(*[F.lit(v) for v in row]).alias("s")).first()["s"] == want


def test_zero_volume_box_is_valid_for_verdicts(spark, fx):
    geometry = fx("fx_mesh_geometry")
    none = spark.createDataFrame([], "object_id string, container_status string")
    degree = spark.createDataFrame([], "object_id string, adjacency_count bigint")
    groups = spark.createDataFrame([], "object_id string, group_id bigint")
    files = geometry.filter("seq % 2 = 0").select("object_id", F.lit(10).alias("size_bytes"))
    rows = validation.validate_objects(geometry, fx("fx_node_info"), fx("fx_geometry_properties"), none, degree, groups, files)
    assert rows.filter("box_volume = 0 and not has_box").count() == 0
    assert rows.filter("box_volume = 0").count() > 0
    assert rows.filter("file_exists").agg(F.sum("file_bytes")).first()[0] == 10 * files.count()
    assert len(frames.validation(rows).columns) == 31


def test_components_cover_boxes_that_have_no_edges(spark, fx):
    geometry = fx("fx_mesh_geometry")
    space = jobs.spatial_job(geometry, edges_from=props.leaf_geometry(geometry))
    skipped = geometry.filter("mesh_quality in ('skipped_container', 'hidden')").select("object_id")
    sizes = space["groups"].join(skipped, "object_id", "left_semi").select("element_count").distinct().collect()
    assert [r["element_count"] for r in sizes] == [1]
    assert space["groups"].count() == geometry.count()


def test_class_rules():
    table = rules.expanded_precedence()
    assert all(a != b or a == "*" for a, b, _, _ in table)
    assert ("Wall", "Wall", "same_level", 4) not in table and ("Beam", "Wall", "same_level", 4) in table
    # Brace is not in the class tree, so it stands for itself only.
    assert rules.superclasses()["Brace"] == ["Brace"] and ("Brace", "Beam", "same_unit", 2) in table
    assert rules.superclasses()["Pipe"] == ["Pipe", "MEPElement", "ModelObject"]
    assert len(rules.level_orders()) == 50


def test_rules_from_a_document():
    made = rules.load_rules(
        {
            "classification_rules": [{"target_class": "x:Wall", "keywords": ["w"]}, {"target_class": "x:Door", "keywords": ["d"], "enabled": False}],
            "systempath_classification": [{"target_class": "x:Pipe", "keywords": ["p"], "priority": 3}],
            "precedence_rules": [{"predecessor_class": "*", "successor_class": "*", "condition": "always", "enabled": True}],
            "level_order": {"L": 1},
            "area_extraction_patterns": [{"property": "x:areaName", "pattern": "(Q[0-9])"}],
            "matching_weights": {"level_match": 0.4, "sys_path_match": 0.1},
            "advanced_settings": {"min_match_score": 0.8, "max_inference_depth": 3},
        }
    )
    assert made["area"] == {"area_name": "(Q[0-9])"} and made["weights"] == {"level": 0.4, "category": 0.25, "name": 0.25, "path": 0.1}
    assert (made["min_score"], made["max_depth"]) == (0.8, 3)
    assert made["classification"] == [("Wall", ["w"])] and made["path"] == [("Pipe", 3, ["p"])]
    assert made["precedence"] == [("*", "*", "always", 0)] and made["level_order"] == {"L": 1}


def test_loaded_rules_reach_their_consumers(spark, fx):
    made = rules.load_rules({"matching_weights": {"level_match": 0.30, "category_match": 0.25, "name_similarity": 0.25, "sys_path_match": 0.20}, "advanced_settings": {"min_match_score": 0.7}, "area_extraction_patterns": [{"property": "x:areaName", "pattern": rules.AREA_PATTERNS["area_name"]}]})
    plan, objects = fx("fx_score_schedule").limit(60), fx("fx_score_objects").limit(60)
    loaded = precedence.scored_matches(plan, objects, made["weights"], made["min_score"])
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, precedence.scored_matches(plan, objects).collect()))
    df = spark.createDataFrame([("Plant > A3 > x",)], "p string")
    assert df.select(classify.extract(F.col("p"), "area_name", made["area"])).first()[0] == "A3"


def test_path_rules_prefer_priority_then_order(spark):
    df = spark.createDataFrame([("a > Structural Column > Beam",), ("x > Water > Tank",), ("Structure",), ("nothing",)], "p string")
    assert [r["c"] for r in df.select(classify.classify_path(F.col("p")).alias("c")).collect()] == ["Column", "Equipment", "StructuralElement", None]


def test_always_rule(spark):
    rows = spark.createDataFrame([("a", "Column", "1F", None, None), ("b", "Beam", "2F", None, None)], "object_id string, class string, level_name string, area_name string, unit_name string")
    edges = precedence.precedence_edges(rows, [("Column", "Beam", "always", 1)]).collect()
    assert [(r["pred_class"], r["succ_class"], r["pred_objects"], r["succ_objects"]) for r in edges] == [("Column", "Beam", 1, 1)]


def test_scored_match_equals_brute_force(spark, fx):
    plan = [r.asDict() for r in fx("fx_score_schedule").limit(120).collect()]
    objects = [r.asDict() for r in fx("fx_score_objects").limit(150).collect()]
    for i, r in enumerate(plan):
        if i % 3 == 0:
            r["name"] = "work package"
    for i, r in enumerate(objects):
        if i % 5 == 0:
            r["name"] = "Work Package" + (" B" if i % 2 else "")

    def tokens(name):
        import re

        return set(t for t in re.split(r"[^\w]+|_", name.lower()) if t)

    want = {}
    for s in plan:
        best = None
        for o in objects:
            a, b = tokens(s["name"]), tokens(o["name"])
            sim = len(a & b) / len(a | b) if a and b else 0
            score = 0.3 * (s["level_name"] == o["level_name"]) + 0.25 * (s["category"] == o["category"]) + 0.2 * (s["path"] == o["path"]) + 0.25 * (sim if sim >= 0.6 else 0)
            key = (-round(score, 6), o["object_id"])
            if round(score, 6) >= 0.7 and (best is None or key < best):
                best = key
        if best:
            want[s["row_id"]] = (best[1], -best[0])
    got = precedence.scored_matches(spark.createDataFrame(plan), spark.createDataFrame(objects)).collect()
    assert {r["row_id"]: (r["object_id"], r["score"]) for r in got} == want and want


def test_groups_of_any_size_are_one_row(spark, fx):
    space = jobs.spatial_job(fx("fx_geometry"), 2.0)
    rows = frames.connected_groups(space["statistics"], space["groups"]).collect()
    assert len({r["GroupId"] for r in rows}) == len(rows)
    for r in rows:
        members = r["MemberObjectIds"].split(";")
        assert members == sorted(members) and len(members) == r["ElementCount"]


def test_turtle_output_and_append(spark, fx, tmp_path):
    triple_rows = triples.geometry_triples(fx("fx_mesh_geometry").limit(3))
    path = str(tmp_path / "ttl")
    writers.write_geometry_turtle(triple_rows, path)
    writers.write_geometry_turtle(triple_rows, path, mode="append")
    lines = text_of(f"{path}/triples").splitlines()
    assert len(lines) == 2 * triple_rows.count() and all(line.endswith(" .") for line in lines)
    assert "@prefix bso: <http://example.org/bso#> ." in text_of(f"{path}/prefixes")


def test_manifest_is_valid_json(spark, fx, tmp_path):
    geometry = fx("fx_mesh_geometry").withColumn("min_x", F.when(F.col("seq") != 1, F.col("min_x")))
    writers.write_manifest(geometry, str(tmp_path / "m"), "Tower", "2026-01-01T00:00:00Z")
    objects = {o["objectId"]: o for o in map(json.loads, text_of(tmp_path / "m/objects").splitlines())}
    assert len(objects) == geometry.count() and objects["O:1"]["bbox"] is None and "meshQuality" in objects["O:1"]
    assert json.loads(text_of(tmp_path / "m/metadata"))["object_count"] == len(objects)


def test_report_text_lists_errors_before_warnings(spark, fx, tmp_path):
    rows = with_parsed(fx("fx_records"))
    writers.write_report(quality.report(rows), quality.all_issues(rows), str(tmp_path / "r"))
    lines = text_of(tmp_path / "r/text").splitlines()
    assert lines[0].startswith("총 객체 수: ")
    kinds = ["E" if "누락" in line else "W" for line in lines[5:]]
    assert kinds == sorted(kinds) and set(kinds) == {"E", "W"}


def test_csv_outputs(spark, fx, tmp_path):
    rows = with_parsed(fx("fx_records"))
    stats = writers.write_dual(rows, str(tmp_path / "dual"))
    assert {r["category"] for r in stats.collect()} == {"Item", "Element", "Dimensions"}
    assert text_of(tmp_path / "dual/refined").splitlines()[0] == "카테고리,속성 이름,데이터 타입,원본 값,숫자 값,단위,DisplayString"
    writers.write_csv(rows.limit(2).select("object_id", "unit"), str(tmp_path / "q"), quote_all=True)
    assert all(line.startswith('"') and line.endswith('"') for line in text_of(tmp_path / "q").splitlines())
    writers.write_hierarchy(rows, str(tmp_path / "h"), include_unit=False)
    assert text_of(tmp_path / "h").splitlines()[0].count(",") == 7
    writers.write_json(rows.limit(5), str(tmp_path / "j"))
    assert "numeric_value" in json.loads(text_of(tmp_path / "j").splitlines()[0])
    writers.write_csv(props.pivot_wide(rows), str(tmp_path / "w"))
    assert text_of(tmp_path / "w").splitlines()[0].endswith("Dimensions|Height,Dimensions|Length,Element|Id,Item|Name,Item|Type")
    edges = spatial.with_names(spatial.adjacency(fx("fx_mesh_geometry"), 0.15), fx("fx_mesh_geometry"))
    assert writers.write_adjacency(edges, str(tmp_path / "a")) and not writers.write_adjacency(edges.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_stored_tables_read_back(spark, fx, tmp_path):
    path = str(tmp_path / "g")
    fx("fx_mesh_geometry").select(*[c for c in tables.GEOMETRY_SCHEMA.fieldNames()]).write.parquet(path)
    assert tables.read_geometry(spark, path).count() == unified.latest_geometry(fx("fx_geometry")).count()
    with_parsed(fx("fx_records")).write.parquet(str(tmp_path / "p"))
    assert tables.read_properties(spark, str(tmp_path / "p")).count() == fx("fx_records").count()


def test_options():
    assert ScheduleOptions().errors() == []
    assert len(ScheduleOptions(property_category=" ", set_root="", min_match_rate=101, retry_count=11, batch_size=0).errors()) == 5
    assert ScheduleOptions.for_production().min_match_rate == 90.0


def burst_rows():
    base = dt.datetime(2026, 1, 1)
    offsets = {"a": [0, 0.1, 0.3, 5, 5.2, 9], "b": [0, 3599.9, 3600.05, 7300], "c": [2]}
    return [(f"{k}{i}", k, base + dt.timedelta(seconds=s)) for k, times in offsets.items() for i, s in enumerate(times)]


def test_debounce_blocks_do_not_matter(spark):
    events = spark.createDataFrame(burst_rows(), "event_id string, key string, ts timestamp")
    want = {"a2", "a4", "a5", "b0", "b2", "b3", "c0"}
    for block in (None, 0.3, 1.0, 100000):
        got = {r["event_id"] for r in debounce(events, "key", "ts", "event_id", 0.3, block).collect()}
        assert got == want


def test_debounce_stream_gives_the_same_bursts(spark, tmp_path):
    events = spark.createDataFrame(burst_rows(), "event_id string, key string, ts timestamp")
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    flush = spark.createDataFrame([("end", "end", dt.datetime(2026, 2, 1))], events.schema)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = (
        debounce_stream(stream, "key", "ts", "event_id", "300 milliseconds", "1 second")
        .writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        q.processAllAvailable()
        flush.write.mode("append").parquet(source)
        q.processAllAvailable()
        q.processAllAvailable()
        got = {r["event_id"] for r in spark.table("bursts").collect()}
    finally:
        q.stop()
    assert got == {"a2", "a4", "a5", "b0", "b2", "b3", "c0"}


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() == 1504 and "object_category" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["B05_stable_ids", "D03_fallback_match", "I25_mesh_quality", "E20_quality_totals", "J01_connected_components", "D18_precedence_edges"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))
