"""Connected components, group statistics and class-level transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.functions.boxes import Box
from girderframe.functions.text import is_empty
from girderframe.operators.numbering import global_row_number, one_row
from girderframe.session import stored, stored_counting, stored_if_any

# Pointers are followed further while more than one in this many still moved.
FEW_MOVED = 20


def component_labels(edges: DataFrame, nodes: DataFrame | None = None, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Label every node with the smallest id of its component; isolated nodes keep their own.

    Each round hooks a node to its smallest neighbour, follows the hooks, and renames the
    ends of all edges. Edges inside a component vanish and the others are merged. About
    half of the names or fewer are left after a round, so the rounds are few even for long
    chains. The minimum is combined before the shuffle, which keeps hubs cheap.
    The renames of all rounds are chained at the end.
    """
    a, b = F.col(source), F.col(target)
    pairs = edges.filter(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    renames: list[DataFrame] = []
    while (left := stored_if_any(pairs, "pairs")) is not None:
        # The smaller end of every edge is u, so only v can hook downwards.
        hooks = left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))
        rename = _followed(hooks)
        renames.append(rename)
        on_u = rename.select(F.col("node").alias("u"), F.col("label").alias("_u"))
        on_v = rename.select(F.col("node").alias("v"), F.col("label").alias("_v"))
        u, v = F.coalesce("_u", "u"), F.coalesce("_v", "v")
        pairs = (
            left.join(on_u, "u", "left")
            .join(on_v, "v", "left")
            .select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
            .filter("u <> v")
            .distinct()
        )
    ends = edges.select(F.explode(F.array(source, target)).alias("object_id"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("object_id"))
    labels = ends.distinct().withColumn("label", F.col("object_id"))
    for rename in renames:
        step = rename.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        labels = labels.join(step, "label", "left").select("object_id", F.coalesce("_next", "label").alias("label"))
    return labels


def _followed(hooks: DataFrame) -> DataFrame:
    """Follow (node, label) pointers towards their end; the reach doubles with every join.

    Stops when few pointers moved in the last step. Those that are not at their end yet
    go on in the next round, where they are still joined to the rest by an edge.
    """

    def doubled(pointers: DataFrame) -> DataFrame:
        step = pointers.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        return pointers.join(step, "label", "left").select(
            "node", F.coalesce("_next", "label").alias("label"), F.col("_next").isNotNull().alias("moved")
        )

    # Most pointers end within two steps, so the first two joins share one table.
    following = doubled(doubled(hooks).drop("moved"))
    while True:
        pointers, rows, moved = stored_counting(following, "pointers", F.col("moved"))
        if moved * FEW_MOVED <= rows:
            return pointers.drop("moved")
        following = doubled(pointers.drop("moved"))


def number_groups(labels: DataFrame) -> DataFrame:
    """Add ``group_id`` 1..n by descending size, then smallest member id."""
    labels = stored(labels, "labels")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("element_count"))
    numbered = global_row_number(sizes, [F.desc("element_count"), F.col("label")], "group_id")
    return labels.join(numbered, "label").select("object_id", "group_id", "element_count")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(object_id, group_id, element_count) for all nodes of the edges and of ``nodes``."""
    return number_groups(component_labels(edges, nodes))


def group_statistics(groups: DataFrame, geometry: DataFrame, edges: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """Count, edges, total volume, union box, centroid and dominant category of each group.

    The edges are given as such, or as ``degrees`` of the objects, where both ends of an edge are in one group.
    """
    box = Box.of()
    members = groups.select("object_id", "group_id").join(
        geometry.select("object_id", "category", *box.columns()), "object_id", "left"
    )
    lows, highs = ["min_x", "min_y", "min_z"], ["max_x", "max_y", "max_z"]
    per_category = members.groupBy("group_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(box.present(), box.volume())).alias("volume"),
        *[F.min(c).alias(c) for c in lows],
        *[F.max(c).alias(c) for c in highs],
    )
    named = ~is_empty(F.col("category"))
    rank = F.when(named, F.struct(-F.col("n"), F.col("category")))
    stats = per_category.groupBy("group_id").agg(
        F.sum("n").alias("element_count"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.min_by(F.col("category"), rank), F.lit("")).alias("dominant_category"),
        *[F.min(c).alias(c) for c in lows],
        *[F.max(c).alias(c) for c in highs],
    )
    # Counted for each object before the groups are known, so that no edge is shuffled.
    if degrees is None:
        per_object, edge_count = edges.groupBy(F.col("source_id").alias("object_id")).agg(F.count(F.lit(1)).alias("_n")), F.sum("_n")
    else:
        per_object, edge_count = degrees.select("object_id", F.col("adjacency_count").alias("_n")), F.expr("sum(_n) div 2")
    counted = groups.select("object_id", "group_id").join(per_object, "object_id").groupBy("group_id").agg(edge_count.alias("edge_count"))
    centre = box.centroid()
    return (
        stats.join(counted, "group_id", "left")
        .withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
        .withColumns({f"centroid_{x}": F.coalesce(c, F.lit(0.0)) for x, c in zip("xyz", centre.axes())})
    )


def group_members(groups: DataFrame, geometry: DataFrame) -> DataFrame:
    """Members of each group with their names."""
    return groups.join(geometry.select("object_id", "display_name"), "object_id", "left").select(
        "group_id", "object_id", F.coalesce("display_name", F.lit("")).alias("display_name")
    )


def spatial_summary(edges: DataFrame | None, groups: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """One row of relation and group counts, from the edges or from the ``degrees`` of all objects by relation."""
    if degrees is None:
        relations = edges.agg(
            F.count(F.lit(1)).alias("total_relations"),
            F.count_if(F.col("relation") == "overlap").alias("overlaps"),
            F.count_if(F.col("relation") == "touch").alias("touches"),
            F.count_if(F.col("relation") == "neartouch").alias("near_touches"),
        )
    else:
        halves = {"total_relations": "adjacency_count", "overlaps": "overlaps", "touches": "touches", "near_touches": "near_touches"}
        relations = degrees.agg(*[F.expr(f"coalesce(sum({c}) div 2, 0L)").alias(name) for name, c in halves.items()])
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    shapes = sizes.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_elements"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
        F.count_if(F.col("n") == 1).alias("singleton_groups"),
        F.count_if(F.col("n") > 1).alias("multi_groups"),
    )
    return one_row(relations, shapes)


def transitive_edges(edges: DataFrame, keys: list[str], depth: int = 5) -> DataFrame:
    """Pairs reachable in at most ``depth`` steps with their shortest step count.

    ``edges`` has predecessor and successor columns prefixed ``pred_`` and ``succ_`` for
    each key; it is meant for class-level nodes, not for single objects.
    """
    pred, succ = [f"pred_{k}" for k in keys], [f"succ_{k}" for k in keys]
    base = stored(edges.select(*pred, *succ).distinct(), "edges")
    found = base.withColumn("depth", F.lit(1))
    frontier = found
    for step in range(2, depth + 1):
        hop = base.select(*[F.col(p).alias(s) for p, s in zip(pred, succ)], *[F.col(s).alias(f"_{s}") for s in succ])
        reached = (
            frontier.join(hop, succ)
            .select(*pred, *[F.col(f"_{s}").alias(s) for s in succ])
            .distinct()
            .join(found.select(*pred, *succ), pred + succ, "left_anti")
            .withColumn("depth", F.lit(step))
        )
        table = stored_if_any(reached, "closure")
        if table is None:
            break
        frontier = table
        found = found.unionByName(frontier)
    return found
