"""Container detection, mesh diagnostics and per-object verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.functions import verdicts
from girderframe.functions.boxes import Box
from girderframe.functions.formats import group_code
from girderframe.functions.text import fixed
from girderframe.schema import EMPTY_GUID

MIN_PARENT_VOLUME = 1e-9
CONTAINER_COVERAGE = 0.5

# Internal names of the geometry properties and their result columns.
GEOMETRY_CATEGORY = "LcOpGeometryProperty"
GEOMETRY_FIELDS = {
    "LcOpGeometryPropertyPrimitives": ("geo_primitives", "int"),
    "LcOpGeometryPropertyHasTriangles": ("geo_has_triangles", "bool"),
    "LcOpGeometryPropertyHasLines": ("geo_has_lines", "bool"),
    "LcOpGeometryPropertySolid": ("geo_solid", "bool"),
    "LcOpGeometryPropertyHasText": ("geo_has_text", "bool"),
    "LcOpGeometryPropertyHasSnapPoints": ("geo_has_snap_points", "bool"),
    "LcOpGeometryPropertyHasPoints": ("geo_has_points", "bool"),
    "LcOpGeometryPropertyFragments": ("geo_fragments", "int"),
}


def containers(links: DataFrame, geometry: DataFrame) -> DataFrame:
    """Parents with an exported child: skipped_container, or partial_container when the
    children fill less than half of the parent box.

    ``links`` holds (parent_id, child_id).
    """
    box = Box.of()
    volumes = geometry.select("object_id", F.when(box.present(), box.volume()).alias("volume"))
    children = (
        links.join(volumes.select(F.col("object_id").alias("child_id"), "volume"), "child_id")
        .groupBy(F.col("parent_id").alias("object_id"))
        .agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("children_volume"), F.count(F.lit(1)).alias("exported_children"))
    )
    parents = children.join(volumes.withColumnRenamed("volume", "parent_volume"), "object_id", "left")
    whole = F.coalesce(F.col("parent_volume") < MIN_PARENT_VOLUME, F.lit(True))
    coverage = F.when(~whole, F.try_divide("children_volume", "parent_volume"))
    return parents.withColumn("coverage", coverage).withColumn(
        "container_status",
        F.when(whole | (F.col("coverage") >= CONTAINER_COVERAGE), F.lit("skipped_container")).otherwise(
            F.lit("partial_container")
        ),
    )


def geometry_properties(properties: DataFrame) -> DataFrame:
    """Geometry properties of each object as typed columns."""
    rows = properties.filter(F.col("category") == GEOMETRY_CATEGORY)
    raw = rows.groupBy("object_id").agg(
        *[
            F.max_by("property_value", F.when(F.col("property_name") == name, F.col("seq"))).alias(column)
            for name, (column, _) in GEOMETRY_FIELDS.items()
        ]
    )
    readers = {"int": verdicts.tolerant_int, "bool": verdicts.tolerant_bool}
    typed = [readers[kind](F.col(column)).alias(column) for column, kind in GEOMETRY_FIELDS.values()]
    return raw.select("object_id", *typed, F.lit(True).alias("has_geometry_property"))


def validate_objects(
    geometry: DataFrame,
    node_info: DataFrame,
    properties: DataFrame,
    container_table: DataFrame,
    degree_table: DataFrame,
    groups: DataFrame,
    mesh_files: DataFrame | None = None,
) -> DataFrame:
    """Per-object verdict row: geometry enriched by five left joins on object_id.

    ``node_info`` carries class_name, level, parent_id, is_leaf, child_count,
    has_geometry and is_hidden; ``mesh_files`` optionally object_id and size_bytes.
    """
    box = Box.of()
    base = geometry.select(
        "object_id",
        F.coalesce("display_name", F.lit("")).alias("display_name"),
        F.coalesce("mesh_quality", F.lit("")).alias("mesh_quality"),
        F.coalesce("has_mesh", F.lit(False)).alias("has_mesh"),
        F.coalesce("vertex_count", F.lit(0)).alias("vertex_count"),
        F.coalesce("triangle_count", F.lit(0)).alias("triangle_count"),
        F.coalesce(box.present() & box.is_valid(), F.lit(False)).alias("has_box"),
        F.coalesce(box.volume(), F.lit(0.0)).alias("box_volume"),
    )
    info = node_info.select(
        "object_id", "class_name", "level", "parent_id", "is_leaf", "child_count", "has_geometry", "is_hidden"
    )
    membership = groups.select("object_id", group_code(F.col("group_id")).alias("group_code"))
    status = container_table.select("object_id", F.col("container_status").alias("_container"))
    joined = base
    for other in (info, geometry_properties(properties), status, degree_table, membership):
        joined = joined.join(other, "object_id", "left")
    if mesh_files is not None:
        joined = joined.join(mesh_files.select("object_id", "size_bytes"), "object_id", "left")
    flags = ["is_leaf", "has_geometry", "is_hidden", "has_geometry_property"]
    flags += [c for c, kind in GEOMETRY_FIELDS.values() if kind == "bool"]
    numbers = ["level", "child_count", "adjacency_count"] + [c for c, kind in GEOMETRY_FIELDS.values() if kind == "int"]
    size = F.col("size_bytes") if mesh_files is not None else F.lit(None).cast("bigint")
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(False)) for c in flags},
            **{c: F.coalesce(c, F.lit(0)) for c in numbers},
            "class_name": F.coalesce("class_name", F.lit("")),
            "parent_id": F.when(F.col("parent_id") != EMPTY_GUID, F.col("parent_id")).otherwise(F.lit("")),
            "group_code": F.coalesce("group_code", F.lit("")),
            "file_exists": size.isNotNull(),
            "file_bytes": F.coalesce(size, F.lit(0)),
        }
    )
    judged = filled.withColumn(
        "container_status",
        verdicts.container_status(
            F.coalesce(F.col("_container") == "skipped_container", F.lit(False)),
            F.coalesce(F.col("_container") == "partial_container", F.lit(False)),
            F.col("has_geometry"),
            F.col("child_count"),
        ),
    ).withColumns(
        {
            "tess_result": verdicts.tess_result(F.col("mesh_quality"), F.col("has_mesh"), F.col("vertex_count")),
            "tess_reason": verdicts.tess_reason(
                *[
                    F.col(c)
                    for c in (
                        "mesh_quality", "has_mesh", "vertex_count", "has_geometry", "is_hidden", "geo_fragments",
                        "has_geometry_property",
                    )
                ]
            ),
        }
    )
    return judged.withColumn(
        "verdict",
        verdicts.verdict(
            *[
                F.col(c)
                for c in (
                    "container_status", "is_hidden", "has_geometry", "has_geometry_property", "mesh_quality",
                    "geo_has_triangles", "tess_result",
                )
            ]
        ),
    ).select(
        "object_id", "display_name", "class_name", "level", "parent_id", "is_leaf", "child_count",
        "has_geometry", "is_hidden", "has_geometry_property",
        *[c for c, _ in GEOMETRY_FIELDS.values()],
        "has_box", "box_volume", "container_status", "tess_result", "tess_reason", "mesh_quality",
        "vertex_count", "triangle_count", "adjacency_count", "group_code", "file_exists", "file_bytes", "verdict",
    )


def verdict_counts(validation: DataFrame) -> DataFrame:
    """Objects per verdict, with those that have triangles but failed."""
    lost = F.col("geo_has_triangles") & (F.col("tess_result") == "failure")
    return validation.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(lost).alias("triangles_but_failed")
    )


def with_mesh_status(diagnostics: DataFrame) -> DataFrame:
    """Add the diagnostic ``status`` of each object's mesh."""
    names = [
        "com_failed", "is_hidden", "is_leaf", "fragment_count", "empty_fragment_count", "triangle_count", "line_count",
    ]
    return diagnostics.withColumn("status", verdicts.mesh_status(*[F.col(c) for c in names]))


def class_summary(diagnostics: DataFrame) -> DataFrame:
    """Mesh outcome per class of leaf objects, most failures first."""
    status = F.col("status")
    rows = (
        with_mesh_status(diagnostics)
        .filter("is_leaf")
        .groupBy(F.coalesce("class_name", F.lit("(none)")).alias("class_name"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status == "OK").alias("ok"),
            F.count_if(status == "LINE_ONLY").alias("line_only"),
            F.count_if(status.isin("EMPTY_TESS", "TESS_FAIL")).alias("empty_tess"),
            F.count_if(status == "NO_FRAGMENTS").alias("no_fragments"),
            F.sum("line_count").alias("total_lines"),
            F.sum("triangle_count").alias("total_triangles"),
        )
    )
    failures = F.col("line_only") + F.col("empty_tess") + F.col("no_fragments")
    return (
        rows.withColumn("failures", failures)
        .withColumn("fail_rate", fixed(F.col("failures") * 100.0 / F.col("total"), 1))
        .orderBy(F.desc("failures"), "class_name")
    )


def failing_classes(summary: DataFrame, top: int = 5) -> DataFrame:
    return summary.filter("failures > 0").orderBy(F.desc("failures"), "class_name").limit(top)


def _mesh_outcome():
    names = ["fragment_count", "empty_fragment_count", "retried_fragments", "line_count", "vertex_count", "triangle_count"]
    return verdicts.mesh_outcome(*[F.col(c) for c in names])


def failures(diagnostics: DataFrame) -> DataFrame:
    """Objects without a mesh, with the ``reason``."""
    reason = verdicts.failure_reason(*[F.col(c) for c in ("has_geometry", "is_hidden", "fragment_count")])
    return diagnostics.filter(_mesh_outcome().isNull()).withColumn("reason", reason)


def failure_counts(diagnostics: DataFrame) -> DataFrame:
    """Objects without a mesh per failure reason."""
    return failures(diagnostics).groupBy("reason").agg(F.count(F.lit(1)).alias("objects"))


def with_mesh_quality(geometry: DataFrame, diagnostics: DataFrame, container_table: DataFrame, supplemented: bool = False) -> DataFrame:
    """Add ``mesh_quality`` from diagnostics and containers.

    With ``supplemented``, targets of the second mesh source count as filled by it.
    """
    columns = [
        "fragment_count", "empty_fragment_count", "retried_fragments", "line_count", "vertex_count", "triangle_count",
        "has_geometry", "is_hidden",
    ]
    box = Box.of()
    status = container_table.select("object_id", F.col("container_status").alias("_container"))
    kept = geometry.drop("mesh_quality", *columns)
    joined = kept.join(diagnostics.select("object_id", *columns), "object_id", "left").join(status, "object_id", "left")
    known = F.col("fragment_count").isNotNull()
    outcome = F.when(known, _mesh_outcome())
    missing = verdicts.failure_reason(*[F.col(c) for c in ("has_geometry", "is_hidden", "fragment_count")])
    reason = F.when(known & outcome.isNull(), missing)
    partial = F.coalesce(F.col("_container") == "partial_container", F.lit(False))
    target = (outcome == "gap_supplemented") | ((reason == "NoGeometry") & partial)
    return joined.withColumn(
        "mesh_quality",
        verdicts.mesh_quality(
            F.coalesce(F.col("_container") == "skipped_container", F.lit(False)),
            outcome,
            reason,
            F.coalesce(box.present() & box.is_valid() & ~box.is_empty(), F.lit(False)),
            F.coalesce(target, F.lit(False)) & F.lit(supplemented),
        ),
    ).drop("_container")


def vertex_statistics(vertices: DataFrame, fragments: DataFrame) -> DataFrame:
    """Vertices, triangles, empty fragments and vertex box per object.

    ``vertices`` is (object_id, fragment_id, idx, x, y, z); ``fragments`` is
    (object_id, fragment_id, triangle_count).
    """
    points = vertices.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("vertex_count"),
        *[F.min(a).alias(f"v_min_{a}") for a in "xyz"],
        *[F.max(a).alias(f"v_max_{a}") for a in "xyz"],
    )
    parts = fragments.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("fragment_count"),
        F.count_if(F.col("triangle_count") == 0).alias("empty_fragment_count"),
        F.sum("triangle_count").alias("triangle_count"),
    )
    return parts.join(points, "object_id", "left").withColumn("vertex_count", F.coalesce("vertex_count", F.lit(0)))
