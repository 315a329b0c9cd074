"""Object tree: traversal, pruning, paths, levels, stable ids and folder paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions import ids
from girderframe.functions.text import is_empty, null_if_blank, path_parts
from girderframe.operators.numbering import one_row
from girderframe.schema import EMPTY_GUID, PATH_SEPARATOR
from girderframe.session import stored_counting


def is_root_parent(parent: Column) -> Column:
    return parent.isNull() | parent.isin("", EMPTY_GUID)


def _piece(name: Column, skip_empty_names: bool) -> list[Column]:
    """A name as a piece of a path: the empty names it begins with, and the text after them (null: none)."""
    return [F.when((name == "") & ~F.lit(skip_empty_names), 1).otherwise(0).alias("blanks"), F.nullif(name, F.lit("")).alias("text")]


def _appended(blanks: Column, text: Column, more_blanks: Column, more_text: Column, separator: str) -> tuple[Column, Column]:
    """A piece with the piece of a lower part of the path behind it. Blank names count inside a path, not ahead of it."""
    rest = F.concat(F.repeat(F.lit(separator), more_blanks), F.coalesce(F.concat(F.lit(separator), more_text), F.lit("")))
    return (
        F.when(text.isNull(), blanks + more_blanks).otherwise(blanks),
        F.when(text.isNull(), more_text).otherwise(F.concat(text, rest)),
    )


def ways_up(inner: DataFrame, count: int, seeded: bool, separator: str) -> DataFrame:
    """(object_id, root_id, level, blanks, text): the ways from inner nodes up to start nodes, found by path doubling.

    ``inner`` has object_id, parent_id, the node's own piece and ``is_start``, ``count`` is the number of its rows.
    A way leads ``steps`` links up and carries the piece below its upper end. Ways of 2^k links are put together
    from two halves, so the rounds grow with the logarithm of the depth. A way ends at the first start node, or
    with ``seeded`` at each that lies above; start nodes also have a way of no links.
    """
    tops = inner.filter("is_start").select(F.col("object_id").alias("up"), F.lit(True).alias("done"), F.col("blanks").alias("top_blanks"), F.col("text").alias("top_text"))
    ways = inner.filter(~is_root_parent(F.col("parent_id"))).select("object_id", F.col("parent_id").alias("up"), "blanks", "text", F.lit(1).alias("steps"))
    ways = ways.join(tops, "up", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    # Below a root no way goes further; a seed may lie below another one.
    ways = ways.withColumn("active", F.lit(True) if seeded else ~F.col("done"))
    finished = inner.filter("is_start").select(
        "object_id", F.col("object_id").alias("root_id"), F.lit(0).alias("level"), "blanks", "text"
    )
    known, reach = None, 1
    while True:
        ways, _, active = stored_counting(ways, "ways", F.col("active"))
        done = ways.filter("done")
        blanks, text = _appended(F.col("top_blanks"), F.col("top_text"), F.col("blanks"), F.col("text"), separator)
        finished = finished.unionByName(done.select("object_id", F.col("up").alias("root_id"), F.col("steps").alias("level"), blanks.alias("blanks"), text.alias("text")))
        if not active:
            return finished
        if reach > count:
            # No way without a cycle has more links than there are nodes. Cycles that no start node reaches end here.
            if not done.isEmpty():
                raise ValueError("the parent links form a cycle below the start nodes")
            return finished
        upper = ways if known is None else ways.unionByName(known)
        known = done.withColumn("active", F.lit(False)) if known is None else known.unionByName(done.withColumn("active", F.lit(False)))
        a, b = ways.filter("active").alias("a"), upper.alias("b")
        blanks, text = _appended(F.col("b.blanks"), F.col("b.text"), F.col("a.blanks"), F.col("a.text"), separator)
        ways = a.join(b, F.col("a.up") == F.col("b.object_id")).select(
            "a.object_id", "b.up", blanks.alias("blanks"), text.alias("text"), (F.col("a.steps") + F.col("b.steps")).alias("steps"),
            "b.done", "b.top_blanks", "b.top_text", "b.active",
        )
        reach *= 2


def walk(
    nodes: DataFrame,
    seeds: DataFrame | None = None,
    *,
    separator: str = PATH_SEPARATOR,
    skip_empty_names: bool = False,
    prune_hidden: bool = True,
) -> DataFrame:
    """Every node below the roots, or below ``seeds`` (a frame of object_id), with its way from the start.

    Adds ``root_id``, ``level`` (0 at the start) and ``path``. A hidden node is never entered, which drops its
    whole subtree. The ways of nodes that have children are found by path doubling; all nodes then meet their
    parent's way in one join, whose hot parents are left to adaptive skew splitting.
    """
    visible = nodes
    if prune_hidden and "is_hidden" in nodes.columns:
        visible = nodes.filter(~F.coalesce("is_hidden", F.lit(False)))
    name = F.coalesce("display_name", F.lit(""))
    is_root = is_root_parent(F.col("parent_id"))
    parents = visible.filter(~is_root).select(F.col("parent_id").alias("object_id")).distinct()
    inner = visible.join(parents, "object_id", "left_semi").select("object_id", "parent_id", *_piece(name, skip_empty_names))
    if seeds is None:
        inner, start = inner.withColumn("is_start", is_root), visible.filter(is_root)
    else:
        wanted = seeds.select("object_id").distinct()
        inner = inner.join(wanted.withColumn("is_start", F.lit(True)), "object_id", "left").withColumn("is_start", F.coalesce("is_start", F.lit(False)))
        start = visible.join(wanted, "object_id", "left_semi")
    inner, count, _ = stored_counting(inner, "inner", F.lit(True))
    above = ways_up(inner, count, seeds is not None, separator)
    above = above.select(F.col("object_id").alias("parent_id"), F.col("root_id").alias("_root"), F.col("level").alias("_level"), F.col("blanks").alias("_blanks"), F.col("text").alias("_text"))
    top = start.withColumns({"root_id": F.col("object_id"), "level": F.lit(0), "path": name})
    blanks, text = _piece(name, skip_empty_names)
    _, path = _appended(F.col("_blanks"), F.col("_text"), blanks, text, separator)
    below = visible.join(above, "parent_id").withColumns({"root_id": F.col("_root"), "level": F.col("_level") + 1, "path": F.coalesce(path, F.lit(""))})
    return top.unionByName(below.select(*top.columns))


def descendants(nodes: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """Subtrees of the seeds; levels and paths restart at each seed."""
    return walk(nodes, seeds, **options)


def emitted_nodes(walked: DataFrame, properties: DataFrame) -> DataFrame:
    """Nodes that yield rows: those with geometry or at least one property."""
    owners = properties.select("object_id").distinct().withColumn("_owner", F.lit(True))
    return (
        walked.join(owners, "object_id", "left")
        .filter(F.coalesce("has_geometry", F.lit(False)) | F.col("_owner").isNotNull())
        .drop("_owner")
    )


def extract_records(walked: DataFrame, properties: DataFrame) -> DataFrame:
    """Property rows of the visited nodes, with parent, level, name and path from the tree."""
    own = ["parent_id", "level", "display_name", "sys_path"]
    identity = walked.select("object_id", "parent_id", "level", "display_name", F.col("path").alias("sys_path"))
    return properties.drop(*own).join(identity, "object_id")


def authoring_ids(properties: DataFrame) -> DataFrame:
    """First non-empty authoring id per object, in property order."""
    prefix = F
    for name, text in ids.AUTHORING_NAMES.items():
        prefix = prefix.when(F.col("property_name") == name, F.lit(text))
    rows = properties.filter(F.col("property_name").isin(list(ids.AUTHORING_NAMES)) & ~is_empty(F.col("property_value")))
    return rows.groupBy("object_id").agg(
        F.min_by(F.concat(prefix, F.col("property_value")), "seq").alias("authoring_id")
    )


def item_guids(properties: DataFrame) -> DataFrame:
    """First valid GUID property of the item category per object."""
    rows = properties.filter(
        F.col("category").isin(ids.ITEM_CATEGORIES)
        & F.col("property_name").isin(ids.GUID_NAMES)
        & ids.is_guid(F.col("property_value"))
    )
    return rows.groupBy("object_id").agg(
        F.min_by(ids.canonical_guid(F.col("property_value")), "seq").alias("item_guid")
    )


def stable_ids(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Add ``stable_id`` to nodes carrying ``instance_id``, ``source_id`` and ``path``."""
    return (
        nodes.join(item_guids(properties), "object_id", "left")
        .join(authoring_ids(properties), "object_id", "left")
        .withColumn(
            "stable_id",
            ids.stable_id(
                F.col("instance_id"), F.col("item_guid"), F.col("authoring_id"), F.col("source_id"), F.col("path")
            ),
        )
    )


def display_names(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Resolve ``display_name``: own name, item name, class, instance id, authoring id, Unknown."""
    item_name = (
        properties.filter((F.col("category") == "Item") & (F.col("property_name") == "Name"))
        .filter(null_if_blank(F.col("property_value")).isNotNull())
        .groupBy("object_id")
        .agg(F.min_by("property_value", "seq").alias("_item_name"))
    )
    chain = F.coalesce(
        null_if_blank(F.col("display_name")),
        F.col("_item_name"),
        null_if_blank(F.col("class_name")),
        ids.null_if_empty_guid(F.col("instance_id")),
        F.nullif(F.col("authoring_id"), F.lit("")),
        F.concat(F.lit("Unknown_"), F.substring("object_id", 1, 8)),
    )
    return (
        nodes.join(item_name, "object_id", "left")
        .join(authoring_ids(properties), "object_id", "left")
        .withColumn("display_name", chain)
        .drop("_item_name", "authoring_id")
    )


def child_links(nodes: DataFrame, geometry: DataFrame) -> DataFrame:
    """Parent to child pairs whose two ends both have geometry."""
    with_box = geometry.select("object_id").distinct()
    return (
        nodes.filter(~is_root_parent(F.col("parent_id")))
        .select("parent_id", "object_id")
        .join(with_box, "object_id", "left_semi")
        .join(with_box.withColumnRenamed("object_id", "parent_id"), "parent_id", "left_semi")
        .select("parent_id", F.col("object_id").alias("child_id"))
    )


def with_child_counts(nodes: DataFrame) -> DataFrame:
    """Add ``child_count`` and ``is_leaf``."""
    counts = (
        nodes.filter(~is_root_parent(F.col("parent_id")))
        .groupBy(F.col("parent_id").alias("object_id"))
        .agg(F.count(F.lit(1)).alias("child_count"))
    )
    return (
        nodes.join(counts, "object_id", "left")
        .withColumn("child_count", F.coalesce("child_count", F.lit(0)))
        .withColumn("is_leaf", F.col("child_count") == 0)
    )


def node_counts(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """One row: all nodes, visible nodes and nodes with geometry."""
    everything = nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if("has_geometry").alias("geometry_nodes")
    )
    visible = walked.agg(F.count(F.lit(1)).alias("visible_nodes"))
    return one_row(everything, visible)


def id_statistics(properties: DataFrame) -> DataFrame:
    """One row of distinct, valid and empty counts for object and parent ids."""

    def distinct_ids(column: str) -> DataFrame:
        empty = is_root_parent(F.col(column))
        kind = column.split("_")[0]
        return (
            properties.groupBy(column)
            .agg(F.count(F.lit(1)).alias("rows"))
            .agg(
                F.sum("rows").alias(f"{kind}_rows"),
                F.count(F.lit(1)).alias(f"distinct_{kind}_ids"),
                F.count_if(empty).alias(f"empty_{kind}_ids"),
                F.count_if(~empty).alias(f"valid_{kind}_ids"),
            )
        )

    objects, parents = distinct_ids("object_id"), distinct_ids("parent_id").drop("parent_rows")
    return one_row(objects.withColumnRenamed("object_rows", "total_rows"), parents)


def lookup(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose object_id is among the wanted ids."""
    return df.join(wanted.select("object_id"), "object_id", "left_semi")


def cut_levels(df: DataFrame, depth: int, exact: bool = False) -> DataFrame:
    return df.filter(F.col("level") == depth if exact else F.col("level") <= depth)


def folder_paths(df: DataFrame, path: str, order: str) -> DataFrame:
    """Distinct folder prefixes of a path column, compared without case.

    The spelling of the first row in ``order`` is kept.
    """
    parts = path_parts(F.col(path))
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts)))
    prefixes = F.transform(steps, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return (
        df.select(F.col(order).alias("_order"), F.explode(prefixes).alias("folder_path"))
        .groupBy(F.lower("folder_path").alias("folder_key"))
        .agg(F.min_by("folder_path", F.struct("_order", "folder_path")).alias("folder_path"))
        .withColumn("depth", F.size(F.split("folder_path", "/")))
        .withColumn("folder_name", F.element_at(F.split("folder_path", "/"), -1))
    )


def flatten_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks of a task tree with their full ``/`` path."""
    return walk(tasks, separator="/", prune_hidden=False).withColumnRenamed("path", "full_path")
