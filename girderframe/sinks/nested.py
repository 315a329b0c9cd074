"""Nested JSON of the object tree, written as globally sorted fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.operators.tree import is_root_parent, walk, ways_up
from girderframe.session import stored_counting

# Sorts before every character of a key; the tilde sorts after the digits a key starts with.
_STEP = "\u0001"
_END = "\u0001~"

_PROPERTY_FIELDS = {
    "Category": "category", "Name": "property_name", "Value": "property_value",
    "RawValue": "raw_value", "DataType": "data_type", "Unit": "unit",
}


def tree_nodes(records: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """First row of each object, with ``was_orphan``.

    An object whose parent has no rows itself hangs under its nearest ancestor that has
    some, found in ``tree`` (object_id, parent_id of all nodes), or under the root when
    there is none or no tree is given. So no subtree is lost.
    """
    firsts = (
        records.groupBy("object_id")
        .agg(F.min_by(F.struct("parent_id", "level", "display_name", "seq"), "seq").alias("_f"))
        .select("object_id", "_f.*")
    )
    known = firsts.select(F.col("object_id").alias("parent_id"), F.lit(True).alias("_has"))
    marked = firsts.join(known, "parent_id", "left").withColumn(
        "was_orphan", ~is_root_parent(F.col("parent_id")) & F.col("_has").isNull()
    )
    adopted = F.when(F.col("_has").isNotNull(), F.col("parent_id")).otherwise(F.lit(""))
    if tree is not None:
        found = nearest_emitted(marked.filter("was_orphan").select("object_id", "parent_id"), tree, known)
        marked = marked.join(found, "object_id", "left")
        adopted = F.coalesce("_ancestor", adopted)
    return marked.select(
        "object_id",
        adopted.alias("parent_id"),
        F.coalesce("display_name", F.lit("")).alias("node_name"),
        F.col("level").alias("node_level"),
        "seq",
        "was_orphan",
    )


def nearest_emitted(orphans: DataFrame, tree: DataFrame, known: DataFrame) -> DataFrame:
    """(object_id, _ancestor): the nearest ancestor with rows, found by path doubling over the nodes that have children.

    Orphans whose parent links lead nowhere, or into a cycle, have none.
    """
    parents = tree.filter(~is_root_parent(F.col("parent_id"))).select(F.col("parent_id").alias("object_id")).unionByName(orphans.select(F.col("parent_id").alias("object_id")))
    inner = tree.select("object_id", "parent_id").join(parents.distinct(), "object_id", "left_semi")
    starts = known.select(F.col("parent_id").alias("object_id"), F.col("_has").alias("is_start"))
    inner = inner.join(starts, "object_id", "left").withColumn("is_start", F.coalesce("is_start", F.lit(False)))
    inner = inner.withColumns({"blanks": F.lit(0), "text": F.lit(None).cast("string")})
    inner, count, _ = stored_counting(inner, "inner", F.lit(True))
    ways = ways_up(inner, count, False, "").select(F.col("object_id").alias("parent_id"), F.col("root_id").alias("_ancestor"))
    return orphans.join(ways, "parent_id").select("object_id", "_ancestor")


def _comma(first: Column) -> Column:
    return F.when(first, F.lit("")).otherwise(F.lit(","))


def nested_json_lines(records: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Lines (key, kind, no, text) which, sorted, form one JSON array of nested nodes.

    A node opens before its properties and children and closes after them. Its key is its
    parent's key followed by its own extraction order, so a global sort puts every fragment
    in place and no task ever holds a subtree.
    """
    order = F.concat(F.lpad(F.col("seq").cast("string"), 20, "0"), F.col("object_id"))
    placed = walk(tree_nodes(records, tree).withColumn("display_name", order), separator=_STEP, prune_hidden=False)
    heads = placed.groupBy("parent_id").agg(F.min("path").alias("_head"))
    nodes = placed.join(heads, "parent_id")
    zero = F.lit(0).cast("bigint")

    def line(key: Column, kind: int, no: Column, text: Column) -> list[Column]:
        return [key.alias("key"), F.lit(kind).alias("kind"), no.alias("no"), text.alias("text")]

    own = F.to_json(
        F.struct(F.col("object_id").alias("ObjectId"), F.col("node_name").alias("DisplayName"), F.col("node_level").alias("Level"))
    )
    opening = F.concat(
        _comma(F.col("path") == F.col("_head")), F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"Properties":[')
    )
    opened = nodes.select(*line(F.col("path"), 0, zero, opening))
    middle = nodes.select(*line(F.col("path"), 2, zero, F.lit('],"Children":[')))
    closed = nodes.select(*line(F.concat("path", F.lit(_END)), 3, zero, F.lit("]}")))
    cells = [
        (F.coalesce(c, F.lit("")) if c in records.columns else F.lit("")).alias(n) for n, c in _PROPERTY_FIELDS.items()
    ]
    keys = nodes.select("object_id", "path", F.col("seq").alias("_first"))
    rows = records.select("object_id", "seq", F.to_json(F.struct(*cells)).alias("_json")).join(keys, "object_id")
    entries = rows.select(
        *line(F.col("path"), 1, F.col("seq"), F.concat(_comma(F.col("seq") == F.col("_first")), F.col("_json")))
    )
    return opened.unionByName(entries).unionByName(middle).unionByName(closed)
