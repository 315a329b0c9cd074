"""Frames with the column names, order and number formats of each output file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions import rdf
from girderframe.functions.boxes import Box
from girderframe.functions.display import with_parsed
from girderframe.functions.formats import group_code
from girderframe.functions.scheduling import iso_date
from girderframe.functions.text import fixed
from girderframe.schema import BOX_COLUMNS

# Column names of the CSV outputs.
HIERARCHY = {
    "ObjectId": "object_id", "ParentId": "parent_id", "Level": "level", "DisplayName": "display_name",
    "Category": "category", "PropertyName": "property_name", "PropertyValue": "property_value",
    "RawValue": "raw_value", "DataType": "data_type", "Unit": "unit",
}
RAW_HEADERS = ["카테고리", "속성 이름", "값"]
REFINED_HEADERS = ["카테고리", "속성 이름", "데이터 타입", "원본 값", "숫자 값", "단위", "DisplayString"]
BOX_HEADERS = ["MinX", "MinY", "MinZ", "MaxX", "MaxY", "MaxZ"]
VALIDATION = {
    "ObjectId": "object_id", "DisplayName": "display_name", "ClassDisplayName": "class_name", "Level": "level",
    "ParentId": "parent_id", "IsLeaf": "is_leaf", "ChildCount": "child_count", "HasGeometry": "has_geometry",
    "IsHidden": "is_hidden", "HasGeometryProperty": "has_geometry_property", "GeoP_Primitives": "geo_primitives",
    "GeoP_HasTriangles": "geo_has_triangles", "GeoP_HasLines": "geo_has_lines", "GeoP_Solid": "geo_solid",
    "GeoP_HasText": "geo_has_text", "GeoP_HasSnapPoints": "geo_has_snap_points", "GeoP_HasPoints": "geo_has_points",
    "GeoP_Fragments": "geo_fragments", "HasBBox": "has_box", "BBoxVolume": "box_volume",
    "ContainerStatus": "container_status", "TessResult": "tess_result", "TessFailureReason": "tess_reason",
    "MeshQuality": "mesh_quality", "VertexCount": "vertex_count", "TriangleCount": "triangle_count",
    "AdjacencyCount": "adjacency_count", "GroupId": "group_code", "GlbExists": "file_exists",
    "GlbSizeBytes": "file_bytes", "Verdict": "verdict",
}


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _flag(c: Column) -> Column:
    return F.initcap(c.cast("string"))


def hierarchy(df: DataFrame, include_unit: bool = True) -> DataFrame:
    """Property rows in 10 columns, or in 8 without data type and unit."""
    names = list(HIERARCHY) if include_unit else list(HIERARCHY)[:8]
    return df.select(*[(F.col("level") if n == "Level" else _text(df, HIERARCHY[n])).alias(n) for n in names])


def raw_properties(df: DataFrame) -> DataFrame:
    columns = ["category", "property_name", "property_value"]
    return df.select(*[_text(df, c).alias(h) for c, h in zip(columns, RAW_HEADERS)])


def refined_properties(df: DataFrame) -> DataFrame:
    """Properties with their display strings parsed."""
    parsed = with_parsed(df)
    number = F.coalesce(rdf.number_text(F.col("numeric_value")), F.lit(""))
    cells = [
        _text(parsed, "category"), _text(parsed, "property_name"), F.col("data_type"), F.col("raw_value"), number,
        F.col("unit"), _text(parsed, "property_value"),
    ]
    return parsed.select(*[c.alias(h) for c, h in zip(cells, REFINED_HEADERS)])


def geometry(df: DataFrame) -> DataFrame:
    """Boxes in 18 columns; a missing box becomes zeros."""
    box = Box.of()
    mesh = F.coalesce("has_mesh", F.lit(False)) if "has_mesh" in df.columns else F.lit(False)

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)

    zero = F.lit(0.0)
    return df.select(
        F.col("object_id").alias("ObjectId"),
        _text(df, "display_name").alias("DisplayName"),
        _text(df, "category").alias("Category"),
        *[F.coalesce(F.col(c), zero).alias(h) for c, h in zip(BOX_COLUMNS, BOX_HEADERS)],
        *[F.coalesce(c, zero).alias(f"Centroid{x}") for c, x in zip(box.centroid().axes(), "XYZ")],
        F.coalesce(box.volume(), zero).alias("Volume"),
        _flag(mesh).alias("HasMesh"),
        _text(df, "mesh_uri").alias("MeshUri"),
        _text(df, "mesh_quality").alias("MeshQuality"),
        count("vertex_count").alias("VertexCount"),
        count("triangle_count").alias("TriangleCount"),
    )


def unified(df: DataFrame, exported_at: str) -> DataFrame:
    """Unified objects in 25 columns with six decimals."""

    def six(name: str) -> Column:
        return F.coalesce(fixed(F.col(name), 6), F.lit(""))

    return df.select(
        F.col("schema_version").alias("SchemaVersion"),
        F.lit(exported_at).alias("ExportedAtUtc"),
        F.col("object_id").alias("ObjectId"),
        F.col("parent_id").alias("ParentId"),
        F.col("level").alias("Level"),
        F.col("display_name").alias("DisplayName"),
        F.col("object_category").alias("ObjectCategory"),
        F.col("hierarchy_path").alias("HierarchyPath"),
        F.col("property_count").alias("PropertyCount"),
        F.col("properties_json").alias("PropertiesJson"),
        *[six(c).alias(f"BBox{h}") for c, h in zip(BOX_COLUMNS, BOX_HEADERS)],
        *[six(f"centroid_{x}").alias(f"Centroid{x.upper()}") for x in "xyz"],
        six("volume").alias("BBoxVolume"),
        F.col("has_mesh").cast("string").alias("HasMesh"),
        F.col("mesh_uri").alias("MeshUri"),
        F.col("mesh_quality").alias("MeshQuality"),
        F.col("vertex_count").alias("VertexCount"),
        F.col("triangle_count").alias("TriangleCount"),
    )


def adjacency(named_edges: DataFrame) -> DataFrame:
    """Edges with names in 10 columns."""
    return named_edges.select(
        F.col("source_id").alias("SourceObjectId"),
        F.col("target_id").alias("TargetObjectId"),
        F.col("source_name").alias("SourceName"),
        F.col("target_name").alias("TargetName"),
        fixed(F.col("distance"), 6).alias("Distance"),
        fixed(F.col("overlap_volume"), 6).alias("OverlapVolume"),
        F.col("relation").alias("RelationType"),
        F.col("source_category").alias("SourceCategory"),
        F.col("target_category").alias("TargetCategory"),
        fixed(F.col("tolerance"), 4).alias("Tolerance"),
    )


def connected_groups(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups in 15 columns, one row each. Member ids are sorted and joined with ``;``.

    The long table of members is ``groups`` itself.
    """
    members = groups.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("object_id")), ";").alias("members"))

    def four(name: str) -> Column:
        return fixed(F.coalesce(F.col(name), F.lit(0.0)), 4)

    return stats.join(members, "group_id").select(
        group_code(F.col("group_id")).alias("GroupId"),
        F.col("element_count").alias("ElementCount"),
        F.col("edge_count").alias("EdgeCount"),
        four("total_volume").alias("TotalVolume"),
        F.col("dominant_category").alias("DominantCategory"),
        *[four(c).alias(f"BBox{h}") for c, h in zip(BOX_COLUMNS, BOX_HEADERS)],
        *[four(f"centroid_{x}").alias(f"Centroid{x.upper()}") for x in "xyz"],
        F.col("members").alias("MemberObjectIds"),
    )


def validation(df: DataFrame) -> DataFrame:
    """Verdict rows in 31 columns."""
    flags = {c for c, t in df.dtypes if t == "boolean"}

    def cell(name: str) -> Column:
        if name in flags:
            return _flag(F.col(name))
        return fixed(F.col(name), 6) if name == "box_volume" else F.col(name)

    return df.select(*[cell(c).alias(h) for h, c in VALIDATION.items()])


# Columns of the mesh diagnostic output.
DIAGNOSTIC = {
    "Depth": ("depth", 0), "HierarchyPath": ("sys_path", ""), "DisplayName": ("display_name", ""),
    "ClassDisplayName": ("class_name", ""), "NodeType": ("node_type", ""), "ChildCount": ("child_count", 0),
    "HasGeometry": ("has_geometry", False), "HasBBox": ("has_box", False), "BBoxVolume": ("box_volume", 0.0),
    "FragmentCount": ("fragment_count", 0), "EmptyFragments": ("empty_fragment_count", 0),
    "FragmentErrors": ("fragment_errors", 0), "VertexCount": ("vertex_count", 0), "TriangleCount": ("triangle_count", 0),
    "LineCount": ("line_count", 0), "PointCount": ("point_count", 0), "SnapPointCount": ("snap_point_count", 0),
    "HasTransform": ("has_transform", False), "IsHidden": ("is_hidden", False), "SourceFile": ("source_file", ""),
    "StrategyTriangles": ("strategy_triangles", ""), "StrategyLines": ("strategy_lines", ""), "Status": ("status", ""),
}


def mesh_diagnostics(df: DataFrame) -> DataFrame:
    """Mesh diagnostics with status in 23 columns; absent inputs take their defaults."""
    rows = df.withColumn("node_type", F.when(F.col("is_leaf"), "LEAF").otherwise("PARENT"))

    def cell(name: str, default) -> Column:
        c = F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
        if isinstance(default, bool):
            return _flag(c)
        return fixed(c, 4) if isinstance(default, float) else c

    return rows.select(*[cell(name, default).alias(h) for h, (name, default) in DIAGNOSTIC.items()])


def tessellation_failures(df: DataFrame) -> DataFrame:
    """Objects without a mesh, with the reason; commas in texts become semicolons."""

    def text(name: str, default: str) -> Column:
        c = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        return F.translate(c, ",", ";")

    return df.select(
        F.col("object_id").alias("ObjectId"),
        text("display_name", "(unnamed)").alias("DisplayName"),
        text("class_name", "").alias("ClassDisplayName"),
        F.col("reason").alias("Reason"),
        text("detail", "").alias("Detail"),
    )


def schedule(df: DataFrame, date_mode: str) -> DataFrame:
    """Generated tasks in 7 columns, or 9 with actual dates."""

    def day(name: str) -> Column:
        return F.coalesce(iso_date(name), F.lit(""))

    actual = [] if date_mode == "planned_only" else [day("actual_start").alias("ActualStart"), day("actual_end").alias("ActualEnd")]
    return df.select(
        F.col("sync_id").alias("SyncID"),
        F.col("task_name").alias("TaskName"),
        day("planned_start").alias("PlannedStart"),
        day("planned_end").alias("PlannedEnd"),
        *actual,
        F.col("task_type").alias("TaskType"),
        F.col("parent_set").alias("ParentSet"),
        F.lit("0").alias("Progress"),
    )


def manifest_objects(df: DataFrame) -> DataFrame:
    """One JSON document per object; a missing box is null, absent names are left out."""
    box = Box.of()

    def point(values) -> Column:
        return F.struct(*[v.alias(a) for v, a in zip(values, "xyz")])

    def json(c: Column) -> Column:
        return F.to_json(c, {"ignoreNullFields": "false"})

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def text_or_null(name: str) -> Column:
        text = _text(df, name)
        return F.when(text == "", F.lit("null")).otherwise(F.concat(F.lit('"'), rdf.escape_json(text), F.lit('"')))

    def optional(name: str, key: str) -> Column:
        return F.when(_text(df, name) != "", member(key, text_or_null(name)))

    mesh = F.coalesce("has_mesh", F.lit(False)) if "has_mesh" in df.columns else F.lit(False)
    numbers = {
        k: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
        for k, c in (("vertexCount", "vertex_count"), ("triangleCount", "triangle_count"))
    }
    centre = [F.coalesce(c, F.lit(0.0)) for c in box.centroid().axes()]
    shape = F.struct(point(box.lo.axes()).alias("min"), point(box.hi.axes()).alias("max"))
    fields = [
        member("objectId", F.concat(F.lit('"'), rdf.escape_json(F.col("object_id")), F.lit('"'))),
        optional("display_name", "displayName"),
        optional("category", "category"),
        member("bbox", F.when(box.present(), json(shape)).otherwise(F.lit("null"))),
        member("centroid", json(point(centre))),
        member("hasMesh", mesh.cast("string")),
        member("meshUri", text_or_null("mesh_uri")),
        member("meshQuality", text_or_null("mesh_quality")),
        *[member(k, c.cast("string")) for k, c in numbers.items()],
    ]
    return df.select("object_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json"))


def manifest_metadata(df: DataFrame, project: str, exported_at: str, generator: str = "girderframe") -> DataFrame:
    """One row: object and mesh counts and the union of all boxes."""
    mesh = F.count_if(F.coalesce("has_mesh", F.lit(False))) if "has_mesh" in df.columns else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("object_count"),
        mesh.alias("mesh_count"),
        *[F.min(c).alias(c) for c in BOX_COLUMNS[:3]],
        *[F.max(c).alias(c) for c in BOX_COLUMNS[3:]],
    ).select(
        F.lit("1.0.0").alias("version"),
        F.lit(generator).alias("generator"),
        F.lit(exported_at).alias("export_date"),
        F.lit(project).alias("project_name"),
        "*",
    )


# Files that the summary names.
SUMMARY_FILES = ["adjacency.csv", "connected_groups.csv", "spatial_relationships.ttl", "spatial_summary.txt"]


def summary_lines(summary: DataFrame) -> DataFrame:
    """Text lines of a one-row spatial summary."""

    def line(label: str, column: str, after: str = "") -> Column:
        return F.concat(F.lit(f"{label}: "), F.format_number(F.col(column), 0), F.lit(after))

    lines = F.array(
        F.lit("--- Adjacency Relations ---"),
        line("Total relations", "total_relations"),
        line("  Overlap", "overlaps"),
        line("  Touch", "touches"),
        line("  NearTouch", "near_touches"),
        F.lit("--- Connected Groups ---"),
        line("Total groups", "total_groups"),
        line("  Total elements", "total_elements"),
        line("  Largest group", "largest_group", " elements"),
        line("  Singleton groups", "singleton_groups"),
        line("  Multi-element groups", "multi_groups"),
        F.lit("--- Output Files ---"),
        *[F.lit(f"  {name}") for name in SUMMARY_FILES],
    )
    return summary.select(F.posexplode(lines).alias("line_no", "line"))


def report_lines(report: DataFrame, issues: DataFrame) -> DataFrame:
    """Report lines in order: totals, then errors, then warnings."""
    labels = {
        "total_objects": "총 객체 수", "total_properties": "총 속성 수", "valid_objects": "유효 객체",
        "warning_count": "경고", "error_count": "오류",
    }
    totals = F.array(*[F.concat(F.lit(f"{t}: "), F.col(c).cast("string")) for c, t in labels.items()])
    head = report.select(F.posexplode(totals).alias("no", "line")).select(
        F.lit(0).alias("section"), F.lit("").alias("object_id"), F.format_string("%02d", "no").alias("detail"), "line"
    )
    error = F.col("severity") == "Error"
    body = issues.select(
        F.when(error, 1).otherwise(2).alias("section"),
        "object_id",
        F.concat_ws("|", "category", "property_name", "details").alias("detail"),
        F.concat(F.lit("  "), "object_name", F.lit(": "), "details", F.lit(" → "), "suggestion").alias("line"),
    )
    return head.unionByName(body)


def issue_json(issues: DataFrame) -> DataFrame:
    names = {
        "object_id": "objectId", "object_name": "objectName", "issue_type": "type", "severity": "severity",
        "category": "category", "property_name": "propertyName", "details": "details", "suggestion": "suggestion",
    }
    entry = F.struct(*[F.coalesce(c, F.lit("")).alias(k) for c, k in names.items()])
    return issues.select("object_id", F.to_json(entry).alias("json"))
