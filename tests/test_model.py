"""Tree, property rows, unified objects and nested output."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from girderframe.functions.display import with_parsed
from girderframe.operators import props, tree, unified
from girderframe.schema import EMPTY_GUID
from girderframe.sinks import nested, writers

NODES = "object_id string, parent_id string, display_name string, is_hidden boolean, has_geometry boolean, seq bigint"
ROWS = "object_id string, parent_id string, level int, display_name string, sys_path string, category string, property_name string, property_value string, seq bigint"


def nodes_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], NODES)


def text_of(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


@pytest.fixture
def model(spark):
    return nodes_of(
        spark,
        [
            ("r", EMPTY_GUID, "Root", False, False),
            ("a", "r", "A", False, False),
            ("b", "r", "B", True, True),
            ("b1", "b", "B1", False, True),
            ("a1", "a", "", False, True),
            ("a2", "a1", "A2", False, True),
            ("q", None, "Other", False, True),
        ],
    )


def test_walk_prunes_hidden_subtrees(spark, model):
    rows = {r["object_id"]: (r["level"], r["path"], r["root_id"]) for r in tree.walk(model).collect()}
    assert rows == {
        "r": (0, "Root", "r"), "a": (1, "Root > A", "r"), "a1": (2, "Root > A > ", "r"),
        "a2": (3, "Root > A >  > A2", "r"), "q": (0, "Other", "q"),
    }


def test_walk_can_skip_empty_names(spark, model):
    rows = {r["object_id"]: r["path"] for r in tree.walk(model, skip_empty_names=True).collect()}
    assert rows["a1"] == "Root > A" and rows["a2"] == "Root > A > A2"


def test_overlapping_seeds_each_give_their_subtree(spark, model):
    seeds = spark.createDataFrame([("a",), ("a1",)], "object_id string")
    rows = sorted((r["root_id"], r["object_id"], r["level"]) for r in tree.descendants(model, seeds).collect())
    assert rows == [("a", "a", 0), ("a", "a1", 1), ("a", "a2", 2), ("a1", "a1", 0), ("a1", "a2", 1)]


def test_cycles_are_reported(spark):
    loop = nodes_of(spark, [("x", "y", "X", False, False), ("y", "x", "Y", False, False)])
    with pytest.raises(ValueError):
        tree.descendants(loop, spark.createDataFrame([("x",)], "object_id string"))


def test_containers_keep_their_place_but_emit_nothing(spark, model):
    rows = spark.createDataFrame([("r", "Item")], "object_id string, category string")
    emitted = {r["object_id"]: r["parent_id"] for r in tree.emitted_nodes(tree.walk(model), rows).collect()}
    assert emitted == {"r": EMPTY_GUID, "a1": "a", "a2": "a1", "q": None}


def test_authoring_id_is_the_first_in_order(spark):
    rows = spark.createDataFrame(
        [("o", "Id", "", 1), ("o", "Handle", "H1", 2), ("o", "Element ID", "9", 3)],
        "object_id string, property_name string, property_value string, seq bigint",
    )
    assert tree.authoring_ids(rows).first()["authoring_id"] == "AutoCAD:H1"


def random_rows(spark, seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        obj = rng.choice("uvwxyz")
        rows.append((obj, "", 1, f"name {obj}", f"p > {obj}", rng.choice("AB"), rng.choice("kl|m"), f"v{i},\"q\"", i))
    return spark.createDataFrame(rows, ROWS)


def test_pivot_and_back_keeps_the_last_values(spark):
    rows = random_rows(spark, 3)
    back = props.unpivot_wide(props.pivot_wide(rows))
    got = {(r["object_id"], r["category"], r["property_name"], r["property_value"]) for r in back.collect()}
    last = props.last_rows(rows, ["object_id", "category", "property_name"])
    assert got == {(r["object_id"], r["category"], r["property_name"], r["property_value"]) for r in last.collect()}


def test_pivot_never_cuts_columns(spark):
    with pytest.raises(ValueError):
        props.pivot_wide(random_rows(spark, 3), max_columns=2)


def test_objects_of_any_size_are_one_row(spark):
    rows = random_rows(spark, 5, 300)
    # Uneven seq: one row far away from the others.
    hot = rows.withColumn("object_id", F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("object_id"))).withColumn("seq", F.when(F.col("seq") == 0, 10**9).otherwise(F.col("seq")))
    groups = props.group_objects(hot)
    assert groups.count() == groups.select("object_id").distinct().count()
    one = groups.filter("object_id = 'hot'").first()
    assert one["property_count"] == 100 == len(one["properties"])
    seqs = [p["seq"] for p in one["properties"]]
    assert seqs == sorted(seqs)
    key = ["object_id", "category", "property_name", "property_value", "seq"]
    assert sorted(props.ungroup(groups).select(*key).collect()) == sorted(hot.select(*key).collect())
    chunks = props.property_chunks(hot, 20).filter("object_id = 'hot'").collect()
    assert len(chunks) == 5 and sum(len(c["properties"]) for c in chunks) == 100 and max(len(c["properties"]) for c in chunks) < 45


def test_selection_joins_group_and_row_marks(spark):
    rows = random_rows(spark, 7, 20).withColumn("is_selected", F.col("seq") == 3)
    chosen = spark.createDataFrame([("u",)], "object_id string")
    got = {r["seq"] for r in props.selected_rows(rows, chosen).collect()}
    assert got == {r["seq"] for r in rows.collect() if r["object_id"] == "u" or r["seq"] == 3}


def test_grouped_filter_drops_empty_categories_only_when_one_is_checked(spark):
    rows = spark.createDataFrame([("o", "", "n", "v"), ("o", "A", "n", "v")], "object_id string, category string, property_name string, property_value string")
    assert props.filter_groups(rows).count() == 2
    assert props.filter_groups(rows, categories=["A"]).count() == 1


def test_search_text_is_literal(spark):
    rows = random_rows(spark, 1, 6).withColumn("property_value", F.when(F.col("seq") == 0, "50%_[x]*").otherwise("50"))
    assert [r["seq"] for r in props.search(rows, "%_[X]*").collect()] == [0]
    assert props.search(rows, "  ").count() == 6


def test_merge_rules(spark):
    rows = spark.createDataFrame(
        [("", "", 1, "none", "", "C", "n", "v", 1), ("a", "p", 2, "A", "x > A", "Element", "Category", "Walls", 2)], ROWS
    )
    boxes = spark.createDataFrame(
        [("a", "Pipe", 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, None, 1), ("g", None, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, None, 2)],
        "object_id string, category string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, display_name string, seq bigint",
    )
    got = {r["object_id"]: r for r in unified.merge(rows, boxes).collect()}
    assert set(got) == {"a", "g"}
    flat, bare = got["a"], got["g"]
    # A box without volume counts as no box but keeps its centroid.
    assert (flat["has_box"], flat["min_x"], flat["centroid_x"], flat["object_category"]) == (False, None, 0.5, "Walls")
    assert (bare["display_name"], bare["object_category"], bare["property_count"], bare["level"], bare["volume"]) == ("Unknown", "", 0, 0, 1.0)
    assert json.loads(flat["properties_json"])[0]["numericValue"] is None


def test_large_objects_are_merged_to_one_row(spark):
    rows = random_rows(spark, 9, 200).withColumn("object_id", F.lit("hot")).unionByName(
        spark.createDataFrame([("hot", "", 1, "late", "p", "Item", "Type", "Walls", 500)], ROWS)
    )
    boxes = spark.createDataFrame([("hot", "Pipe", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1)], "object_id string, category string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, seq bigint")
    merged = unified.merge(rows, boxes).collect()
    assert [(r["property_count"], r["object_category"], r["volume"]) for r in merged] == [(201, "Walls", 1.0)]


def test_deep_orphans_find_their_ancestor(spark):
    from girderframe.sinks.nested import nearest_emitted

    tree_rows = [("top", "")] + [(f"n{k}", "top" if k == 0 else f"n{k - 1}") for k in range(6)]
    nodes = spark.createDataFrame(tree_rows, "object_id string, parent_id string")
    known = spark.createDataFrame([("top", True)], "parent_id string, _has boolean")
    orphans = spark.createDataFrame([("leaf", "n5")], "object_id string, parent_id string")
    assert [tuple(r) for r in nearest_emitted(orphans, nodes, known).collect()] == [("leaf", "top")]


def test_nested_json_is_one_tree(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            ("r", EMPTY_GUID, 0, "Root", "", "Item", "n1", 'v "1"', 1), ("r", EMPTY_GUID, 0, "Root", "", "Item", "n2", "v2", 2),
            ("c-2", "r", 1, "Two", "", "Item", "n", "v", 9), ("c", "r", 1, "One", "", "Item", "n", "v", 5),
            ("d", "c", 2, "Deep", "", "Item", "n", "v", 6), ("lost", "gone", 3, "Lost", "", "Item", "n", "v", 7),
        ],
        ROWS,
    )
    writers.write_nested_json(with_parsed(rows), str(tmp_path / "tree"))
    roots = json.loads("[" + text_of(tmp_path / "tree") + "]")
    assert [n["ObjectId"] for n in roots] == ["r", "lost"]
    root = roots[0]
    assert [p["Name"] for p in root["Properties"]] == ["n1", "n2"] and root["Properties"][0]["Value"] == 'v "1"'
    assert [(c["ObjectId"], c["Level"]) for c in root["Children"]] == [("c", 1), ("c-2", 1)]
    assert root["Children"][0]["Children"][0]["ObjectId"] == "d"
    assert [r["object_id"] for r in nested.tree_nodes(rows).filter("was_orphan").collect()] == ["lost"]


def test_orphans_climb_to_the_nearest_emitted_ancestor(spark):
    rows = spark.createDataFrame(
        [("r", "", 0, "Root", "", "Item", "n", "v", 1), ("x", "m2", 3, "X", "", "Item", "n", "v", 2), ("y", "gone", 3, "Y", "", "Item", "n", "v", 3)], ROWS
    )
    tree_rows = spark.createDataFrame([("m2", "m1"), ("m1", "r"), ("r", ""), ("x", "m2")], "object_id string, parent_id string")
    got = {r["object_id"]: (r["parent_id"], r["was_orphan"]) for r in nested.tree_nodes(rows, tree_rows).collect()}
    assert got == {"r": ("", False), "x": ("r", True), "y": ("", True)}


def test_results_do_not_depend_on_partitions(spark, fx):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            merged = unified.merge(fx("fx_records"), fx("fx_geometry"))
            results.append(merged.agg(F.sum(F.xxhash64(*merged.columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
