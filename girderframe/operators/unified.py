"""Properties and geometry merged to one row per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions.boxes import Box
from girderframe.functions.display import with_parsed
from girderframe.operators.props import group_objects, properties_json
from girderframe.schema import BOX_COLUMNS, EMPTY_GUID, SCHEMA_VERSION

# Item properties that name the category of an object.
ITEM_TYPE_NAMES = ["Type", "Category", "유형"]

MESH_DEFAULTS = {
    "has_mesh": False, "mesh_uri": "", "mesh_quality": "", "vertex_count": 0, "triangle_count": 0,
}


def latest_geometry(geometry: DataFrame) -> DataFrame:
    """Usable boxes: with an id and all bounds, not empty; the last record of an id wins."""
    box = Box.of()
    usable = geometry.filter(
        F.col("object_id").isNotNull()
        & ~F.col("object_id").isin("", EMPTY_GUID)
        & box.present()
        & ~box.is_empty()
    )
    others = [c for c in geometry.columns if c != "object_id"]
    return (
        usable.groupBy("object_id").agg(F.max_by(F.struct(*others), "seq").alias("_g")).select("object_id", "_g.*")
    )


def object_category() -> Column:
    """Aggregate: the item type, else the element category, else the category of the first row."""
    item = (F.col("category") == "Item") & F.col("property_name").isin(ITEM_TYPE_NAMES)
    element = (F.col("category") == "Element") & (F.col("property_name") == "Category")

    def first(test: Column, column: str) -> Column:
        # The struct keeps a NULL value apart from no row at all.
        value = F.struct(F.coalesce(column, F.lit("")).alias("v"))
        return F.min_by(F.when(test, value), F.when(test, F.col("seq")))["v"]

    return F.coalesce(first(item, "property_value"), first(element, "property_value"), first(F.lit(True), "category"))


def object_categories(df: DataFrame) -> DataFrame:
    """Category per object."""
    return df.groupBy("object_id").agg(object_category().alias("object_category"))


def merge(properties: DataFrame, geometry: DataFrame, with_json: bool = True) -> DataFrame:
    """Full outer merge of property rows and boxes.

    Objects with empty ids are left out. A box without properties keeps its name, or
    ``Unknown``. A zero-volume box counts as no box, but keeps its centroid. There is
    one row for each object, whatever the number of its properties.
    """
    named = ~F.col("object_id").isin("", EMPTY_GUID)
    rows = properties.filter(named)
    if with_json and "raw_value" not in rows.columns:
        rows = with_parsed(rows)
    if with_json:
        groups = group_objects(rows, {"object_category": object_category()}).withColumn(
            "properties_json", properties_json(F.col("properties"))
        )
    else:
        identity = [c for c in ("parent_id", "level", "display_name", "sys_path") if c in rows.columns]
        groups = (
            rows.groupBy("object_id")
            .agg(
                object_category().alias("object_category"),
                F.count(F.lit(1)).alias("property_count"),
                F.min_by(F.struct(*identity), "seq").alias("_i"),
            )
            .select("object_id", "_i.*", "object_category", "property_count")
        )
    groups = groups.withColumn("_known", F.lit(True))
    optional = [c for c in ("display_name", *MESH_DEFAULTS) if c in geometry.columns]
    boxes = geometry.filter(named).select(
        "object_id",
        *[F.col(c).alias(f"_{c}") for c in BOX_COLUMNS],
        F.col("category").alias("_category"),
        *[F.col(c).alias(f"_{c}") for c in optional],
    )
    joined = groups.join(boxes, "object_id", "full")
    known = F.col("_known").isNotNull()
    box = Box.of("_")
    has_box = F.coalesce(box.present() & ~box.is_empty(), F.lit(False))

    def geometry_value(name: str, default) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(default)) if name in optional else F.lit(default)

    own_name = F.col("display_name") if "display_name" in groups.columns else F.lit("")
    box_name = F.col("_display_name") if "display_name" in optional else F.lit(None).cast("string")
    path = F.col("sys_path") if "sys_path" in groups.columns else F.lit("")
    centre = box.centroid()
    columns = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "object_id": F.col("object_id"),
        "parent_id": F.coalesce("parent_id", F.lit("")),
        "level": F.coalesce("level", F.lit(0)),
        "display_name": F.when(known, F.coalesce(own_name, F.lit(""))).otherwise(F.coalesce(box_name, F.lit("Unknown"))),
        "object_category": F.when(known, F.col("object_category")).otherwise(F.coalesce("_category", F.lit(""))),
        "hierarchy_path": F.coalesce(path, F.lit("")),
        "property_count": F.coalesce("property_count", F.lit(0)),
        "has_box": has_box,
        **{c: F.when(has_box, F.col(f"_{c}")) for c in BOX_COLUMNS},
        "centroid_x": centre.x,
        "centroid_y": centre.y,
        "centroid_z": centre.z,
        "volume": F.when(has_box, box.volume()),
        **{name: geometry_value(name, default) for name, default in MESH_DEFAULTS.items()},
    }
    if with_json:
        columns["properties_json"] = F.coalesce("properties_json", F.lit("[]"))
    return joined.select(*[c.alias(n) for n, c in columns.items()])


def global_box(geometry: DataFrame) -> DataFrame:
    """One row: the union of all boxes."""
    return geometry.agg(
        *[F.min(c).alias(c) for c in BOX_COLUMNS[:3]], *[F.max(c).alias(c) for c in BOX_COLUMNS[3:]]
    )
