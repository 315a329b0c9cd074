"""Adjacency against brute force, components against union-find, numbering."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from girderframe.operators import graph, spatial
from girderframe.operators.numbering import global_row_number
from girderframe.session import stored

SCHEMA = "object_id string, category string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, seq bigint"


def frame(spark, boxes, category="Misc"):
    return spark.createDataFrame([(f"b{i:05d}", category, *map(float, b), i) for i, b in enumerate(boxes)], SCHEMA)


def brute(boxes, limit):
    lo, hi = np.array([b[:3] for b in boxes], float), np.array([b[3:] for b in boxes], float)
    out = set()
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(lo[i] - hi[i + 1:], lo[i + 1:] - hi[i]))
        near = np.sqrt((gap**2).sum(axis=1)) <= limit
        out |= {(f"b{i:05d}", f"b{i + 1 + j:05d}") for j in np.nonzero(near)[0]}
    return out


def pairs(edges):
    rows = [(r["source_id"], r["target_id"]) for r in edges.select("source_id", "target_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_boxes(seed, n=250):
    rng = random.Random(seed)
    boxes = []
    for i in range(n):
        size = [rng.choice([0, 0.01, 0.3, 1, 2.5]) * rng.random() for _ in range(3)]
        if i % 40 == 0:
            size = [30, 0.2, 12]
        if i % 41 == 0:
            size = [0.05, 0.05, 25]
        at = [rng.uniform(-8, 8) for _ in range(3)]
        boxes.append((*at, *[a + s for a, s in zip(at, size)]))
    return boxes


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_adjacency_equals_brute_force(spark, seed):
    boxes = random_boxes(seed)
    options = spatial.GridOptions(max_cells=8 if seed == 1 else 32)
    assert pairs(spatial.adjacency(frame(spark, boxes), 0.15, options)) == brute(boxes, 0.15)


def test_split_cells_give_the_same_pairs(spark):
    boxes = random_boxes(4)
    # A third of all boxes share one place.
    boxes += [(0, 0, 0, 0.1, 0.1, 0.1)] * 120
    options = spatial.GridOptions(hot_pairs=50, block=7)
    assert pairs(spatial.adjacency(frame(spark, boxes), 0.15, options)) == brute(boxes, 0.15)


def test_evenly_full_cells_are_not_copied_into_many_blocks(spark):
    boxes = [(k % 40 * 10.1, 0.1, 0.1, k % 40 * 10.1 + 0.1, 0.2, 0.2) for k in range(40 * 60)]
    placed = frame(spark, boxes).withColumns({"reach": F.lit(0.0), "own_grid": F.lit(0)})
    rows = spatial._register(placed, 0.5, [0])
    own, everything = spatial._split_hot_cells(rows, rows.filter("own"), spatial.GridOptions(hot_pairs=20, block=3))
    assert own.count() <= 4 * rows.count() and everything.count() <= 4 * rows.count()



def test_boxes_of_one_shape_meet_others_as_one(spark, monkeypatch):
    """All pairs of copies come out, each once; the join sees packs, not boxes."""
    monkeypatch.setattr(spatial, "PACK", 7)
    boxes = [(0, 0, 0, 1, 1, 1)] * 40 + [(1.1, 0, 0, 2, 1, 1)] * 30 + [(9, 9, 9, 9.5, 9.5, 9.5), (2.05, 0, 0, 3, 1, 1)]
    for options in (spatial.GridOptions(), spatial.GridOptions(hot_pairs=10, block=3, shares=8)):
        assert pairs(spatial.adjacency(frame(spark, boxes), 0.15, options)) == brute(boxes, 0.15)
    measured, _ = spatial._measured(frame(spark, boxes), 0.15, spatial.GridOptions())
    assert spatial._packs(measured, ()).count() < 30


def test_pair_across_a_cell_border(spark):
    boxes = [(0.1, 0, 0, 0.4375, 0.1, 0.1), (0.5625, 0, 0, 0.9, 0.1, 0.1), (1.04, 0, 0, 1.2, 0.1, 0.1)]
    assert pairs(spatial.adjacency(frame(spark, boxes), 0.125)) == {("b00000", "b00001")}
    assert len(pairs(spatial.adjacency(frame(spark, boxes), 0.15))) == 2


def test_pair_tolerance_is_the_larger_one(spark):
    boxes = [(0, 0, 0, 1, 1, 1), (1.1875, 0, 0, 2, 1, 1)]
    both = frame(spark, boxes, "Pipe")
    assert pairs(spatial.adjacency(both)) == set()
    mixed = both.withColumn("category", F.when(F.col("seq") == 0, "Structure").otherwise("Pipe"))
    assert pairs(spatial.adjacency(mixed)) == {("b00000", "b00001")}


def test_missing_boxes_take_no_part(spark):
    boxes = frame(spark, [(0, 0, 0, 1, 1, 1), (0, 0, 0, 1, 1, 1)])
    gone = boxes.withColumn("min_x", F.when(F.col("seq") == 0, F.col("min_x")))
    assert spatial.adjacency(gone, 0.1).count() == 0
    assert spatial.adjacency(boxes.limit(0), 0.1).count() == 0


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "source_id string, target_id string")


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "reversed", "star", "random"])
def test_components(spark, kind):
    names = [f"n{i:03d}" for i in range(90)]
    rng = random.Random(7)
    edges = {
        "chain": list(zip(names, names[1:])),
        "reversed": [(b, a) for a, b in zip(names, names[1:])][::-1],
        "star": [(names[-1], n) for n in names[:-1]],
        "random": [tuple(rng.sample(names, 2)) for _ in range(60)] + [(names[0], names[0])],
    }[kind]
    nodes = spark.createDataFrame([(n,) for n in [*names, "zz"]], "object_id string")
    got = {r["object_id"]: r["label"] for r in graph.component_labels(edge_frame(spark, edges), nodes).collect()}
    assert got == union_find(edges, [*names, "zz"])
    shuffled = rng.sample(edges, len(edges))
    again = {r["object_id"]: r["label"] for r in graph.component_labels(edge_frame(spark, shuffled), nodes).collect()}
    assert again == got


def test_group_numbers_order_by_size_then_id(spark):
    edges = edge_frame(spark, [("d", "e"), ("a", "b"), ("b", "c")])
    nodes = spark.createDataFrame([("x",), ("w",)], "object_id string")
    got = {r["object_id"]: r["group_id"] for r in graph.components(edges, nodes).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "w": 3, "x": 4}


def test_dominant_category_breaks_ties_by_name(spark):
    boxes = frame(spark, [(0, 0, 0, 1, 1, 1), (1, 0, 0, 2, 1, 1)]).withColumn(
        "category", F.when(F.col("seq") == 0, "Pipe").otherwise("Duct")
    )
    edges = spatial.adjacency(boxes, 0.1)
    row = graph.group_statistics(graph.components(edges, boxes), boxes, edges).first()
    assert (row["dominant_category"], row["edge_count"], row["total_volume"], row["centroid_x"]) == ("Duct", 1, 2.0, 1.0)


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_global_row_number(spark, partitions):
    rng = random.Random(5)
    values = rng.sample(range(10_000), 700)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
        got = {r["v"]: r["row_no"] for r in global_row_number(df, [F.desc("v")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {v: i + 1 for i, v in enumerate(sorted(values, reverse=True))}


def test_closure_stops_at_the_depth(spark):
    names = "abcdefgh"
    edges = spark.createDataFrame(list(zip(names, names[1:])), "pred_k string, succ_k string")
    found = graph.transitive_edges(edges, ["k"], 5).collect()
    assert {(r["pred_k"], r["succ_k"], r["depth"]) for r in found} == {
        (names[i], names[i + d], d) for i in range(8) for d in range(1, 6) if i + d < 8
    }


@pytest.mark.parametrize("tolerance", [0.15, None])
def test_labels_of_boxes_equal_those_of_all_edges(spark, tolerance):
    boxes = random_boxes(7) + [(0, 0, 0, 0.1, 0.1, 0.1)] * 60 + [(20 + 0.24 * k, 0, 0, 20.1 + 0.24 * k, 0.1, 0.1) for k in range(60)]
    geometry = frame(spark, boxes)
    options = spatial.GridOptions(hot_pairs=50, block=7)
    whole = graph.component_labels(spatial.adjacency(geometry, tolerance), geometry)
    got = spatial.component_labels(geometry, tolerance, options=options)
    assert sorted(map(tuple, got.select("object_id", "label").collect())) == sorted(map(tuple, whole.collect()))


def test_labels_of_boxes_do_not_make_all_pairs(spark, monkeypatch):
    """600 boxes at one place have 179,700 pairs; no stored table holds more than a few rows a box."""
    written = []
    monkeypatch.setattr(spatial, "stored", lambda df, label: written.append(df.count()) or stored(df, label))
    labels = spatial.component_labels(frame(spark, [(0, 0, 0, 0.1, 0.1, 0.1)] * 600), 0.15)
    assert {r["label"] for r in labels.collect()} == {"b00000"} and max(written) <= 8 * 600


@pytest.mark.parametrize("tolerance", [None, 0.15])
def test_edge_counts_equal_the_edges(spark, tolerance):
    rng = random.Random(3)
    places = [(x, y, z, x + 1, y + 1, z + 1) for x, y, z in ((rng.randint(0, 6) * 0.55, rng.randint(0, 6) * 0.55, rng.choice([0, 1.1])) for _ in range(60))]
    # Copies, a large box, touching boxes, and copies with swapped corners that are far from themselves.
    boxes = frame(spark, [*places, *places[:9], (0, 0, 0, 9, 9, 9), (20, 0, 0, 21, 1, 1), (21, 0, 0, 22, 1, 1), (40, 0, 0, 30, 1, 1), (40, 0, 0, 30, 1, 1)])
    boxes = boxes.withColumn("category", F.when(F.col("seq") % 2 == 0, "Pipe").otherwise("Structure"))
    ends = spatial.adjacency(boxes, tolerance).select("relation", F.explode(F.array("source_id", "target_id")).alias("object_id"))
    want = {r["object_id"]: tuple(r)[1:] for r in ends.groupBy("object_id").agg(F.count(F.lit(1)), *[F.count_if(F.col("relation") == k) for k in spatial.RELATIONS.values()]).collect()}
    for options in (spatial.GridOptions(), spatial.GridOptions(hot_pairs=20, block=3)):
        assert {r["object_id"]: tuple(r)[1:] for r in spatial.edge_counts(boxes, tolerance, options).collect()} == want


def test_statistics_of_groups_make_no_edges(spark, fx, monkeypatch):
    from girderframe.plans import jobs

    geometry = fx("fx_geometry")
    edges = spatial.adjacency(geometry, 2.0)
    groups = graph.components(edges, geometry)
    want = [sorted(map(tuple, df.collect())) for df in (groups, graph.group_statistics(groups, geometry, edges), graph.spatial_summary(edges, groups))]

    def refuse(*_args, **_options):
        raise AssertionError("edges were made")

    monkeypatch.setattr(spatial, "adjacency", refuse)
    space = jobs.spatial_job(geometry, 2.0)
    assert [sorted(map(tuple, space[name].collect())) for name in ("groups", "statistics", "summary")] == want


def test_copies_of_a_box_cost_no_pairs(spark, fx):
    """4,000 boxes at one place have 7,998,000 edges; their counts follow from one box."""
    boxes = spark.range(4_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("object_id"), F.lit("Pipe").alias("category"), *[F.lit(float(v)).alias(c) for c, v in zip(spatial.BOX_COLUMNS, (0, 0, 0, 1, 1, 1))])
    assert spatial.edge_counts(boxes, 0.1).agg(F.min("adjacency_count"), F.max("overlaps"), F.sum("touches")).first() == (3_999, 3_999, 0)


def exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_names_of_edges_come_with_the_boxes(spark, fx):
    geometry = fx("fx_mesh_geometry")
    named = spatial.named_adjacency(geometry, 0.15)
    assert exchanges(named) == exchanges(spatial.adjacency(geometry, 0.15))
    joined = spatial.with_names(spatial.adjacency(geometry, 0.15), geometry)
    assert sorted(map(str, named.select(*sorted(named.columns)).collect())) == sorted(map(str, joined.select(*sorted(named.columns)).collect()))


def test_edge_triples_format_only_what_is_kept(spark):
    from girderframe.functions import rdf
    from girderframe.operators import triples

    values = [0.0, 0.0000005, 0.0000015, 0.15, 0.1234565, 1.9999995, 1.9999999, 999999.9999999, 1e6, 1e20, -0.25, 0.1 + 0.2, 2 / 3, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", rdf.fixed_text(F.col("v"), 6).alias("a"), F.format_string("%.6f", "v").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    edges = spark.createDataFrame([("a-1", "b", 0.05, 0.0), ("b", "c", 0.0, 0.5)], "source_id string, target_id string, distance double, overlap_volume double")
    made = triples.edge_triples(edges)
    assert made.count() == 5 and {r["s"] for r in made.collect()} == {"inst:obj_a_1", "inst:obj_b"}
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_not_shuffled(spark, fx, monkeypatch):
    """Boxes are shuffled by tile; their rows in cells, some for each box, stay in the task, and Java compiles what makes them."""
    import re

    plans = {}

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noted(df, label):
        plans[label] = plan_of(df)
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen"))
        assert label != "boxes" or all(int(n) < 8_000 for n in sizes)
        return stored(df, label)

    monkeypatch.setattr(spatial, "stored", noted)
    geometry = fx("fx_geometry")
    for name, df in (("edges", spatial.adjacency(geometry, 0.15)), ("counts", spatial.edge_counts(geometry, 0.15))):
        plans[name] = plan_of(df)
    spatial.component_labels(geometry, 0.15)
    for name in ("edges", "counts", "near", "mixed"):
        assert not re.search(r"Exchange hashpartitioning\([^)]*cx#", plans[name]) and "hashpartitioning(grid#" in plans[name].replace("own_grid#", "grid#"), name


@pytest.mark.parametrize("tolerance", [None, 0.15])
def test_labels_of_repeated_and_missing_ids(spark, tolerance):
    """Boxes of one id are one node wherever they lie; nodes without a box keep their own label."""
    rng = random.Random(5)
    places = [tuple(rng.randint(0, 9) * 0.6 for _ in range(3)) for _ in range(80)]
    boxes = frame(spark, [(x, y, z, x + 0.5, y + 0.5, z + 0.5) for x, y, z in places] + [(90, 0, 0, 80, 1, 1), (85, 0, 0, 86, 1, 1)])
    odd = boxes.withColumn("object_id", F.when(F.col("seq") % 9 == 4, F.lit(None)).when(F.col("seq") % 7 == 3, F.lit("twice")).otherwise(F.col("object_id")))
    nodes = odd.select("object_id").unionByName(spark.createDataFrame([("alone",)], "object_id string"))
    whole = graph.component_labels(spatial.adjacency(odd, tolerance), nodes)
    assert sorted(map(str, spatial.component_labels(odd, tolerance, nodes).select("object_id", "label").collect())) == sorted(map(str, whole.select("object_id", "label").collect()))
