"""Status waterfalls for containers, tessellation, mesh quality and the final verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as true, and mesh qualities that count as success.
TRUE_TEXTS = ["예", "Yes", "True", "true", "1"]
SUCCESS_QUALITIES = [
    "full_mesh", "partial_retry_success", "gap_supplemented", "line_mesh", "fbx_supplemented",
]


def tolerant_int(text: Column) -> Column:
    """Integer of a text or number text, truncated; 0 when unreadable."""
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"), F.lit(0))


def tolerant_bool(text: Column) -> Column:
    return F.coalesce(text.isin(TRUE_TEXTS), F.lit(False))


def container_status(is_container: Column, is_partial: Column, has_geometry: Column, child_count: Column) -> Column:
    return (
        F.when(is_container, F.lit("skipped_container"))
        .when(is_partial, F.lit("partial_container"))
        .when(~has_geometry & (child_count > 0), F.lit("no_geometry_group"))
        .otherwise(F.lit("none"))
    )


def _other_quality_success(has_mesh: Column, vertex_count: Column) -> Column:
    return has_mesh & (vertex_count > 0)


def tess_result(quality: Column, has_mesh: Column, vertex_count: Column) -> Column:
    q = F.coalesce(quality, F.lit(""))
    return (
        F.when(q.isin(SUCCESS_QUALITIES), F.lit("success"))
        .when(q == "box_placeholder", F.lit("failure"))
        .when(q.isin("skipped_container", "hidden", "no_geometry"), F.lit("skipped"))
        .when(_other_quality_success(has_mesh, vertex_count), F.lit("success"))
        .otherwise(F.lit("failure"))
    )


def tess_reason(
    quality: Column,
    has_mesh: Column,
    vertex_count: Column,
    has_geometry: Column,
    is_hidden: Column,
    fragments: Column,
    has_geometry_property: Column,
) -> Column:
    q = F.coalesce(quality, F.lit(""))
    box_reason = (
        F.when(~has_geometry, F.lit("NoGeometry"))
        .when(is_hidden, F.lit("Hidden"))
        .when((fragments == 0) & has_geometry_property, F.lit("NoFragments"))
        .otherwise(F.lit("AllStrategiesFail"))
    )
    return (
        F.when(q.isin(SUCCESS_QUALITIES), F.lit("None"))
        .when(q == "box_placeholder", box_reason)
        .when(q == "skipped_container", F.lit("Container"))
        .when(q == "hidden", F.lit("Hidden"))
        .when(q == "no_geometry", F.lit("NoGeometry"))
        .when(_other_quality_success(has_mesh, vertex_count), F.lit("None"))
        .otherwise(F.lit("Unknown"))
    )


def verdict(
    container: Column,
    is_hidden: Column,
    has_geometry: Column,
    has_geometry_property: Column,
    quality: Column,
    has_triangles: Column,
    tess: Column,
) -> Column:
    """Final verdict of an object; the first matching rule decides."""
    q = F.coalesce(quality, F.lit(""))
    lost_or_boxed = F.when(has_triangles, F.lit("FAIL_NO_EXTRACT")).otherwise(F.lit("WARN_BOX"))
    placeholder = (
        F.when(has_triangles, F.lit("FAIL_NO_EXTRACT"))
        .when(has_geometry, F.lit("WARN_BOX"))
        .otherwise(F.lit("SKIP_NO_GEOMETRY"))
    )
    return (
        F.when(container == "skipped_container", F.lit("SKIP_CONTAINER"))
        .when(is_hidden, F.lit("SKIP_HIDDEN"))
        .when(~has_geometry & ~has_geometry_property, F.lit("SKIP_NO_GEOMETRY"))
        .when(q.isin("full_mesh", "gap_supplemented", "partial_retry_success"), F.lit("OK_MESH"))
        .when(q == "line_mesh", F.lit("OK_LINE_MESH"))
        .when(q == "fbx_supplemented", F.lit("OK_FBX"))
        .when(q == "box_placeholder", placeholder)
        .when(~has_geometry, F.lit("WARN_BOX"))
        .when(tess == "failure", lost_or_boxed)
        .otherwise(F.lit("UNKNOWN"))
    )


def mesh_outcome(fragments: Column, empty: Column, retried: Column, lines: Column, vertices: Column, triangles: Column) -> Column:
    """Quality of an extracted mesh; NULL when no valid mesh came out."""
    produced = (vertices >= 3) & (triangles >= 1)
    return F.when(
        produced,
        F.when((lines > 0) & (empty == fragments), F.lit("line_mesh"))
        .when((empty > 0) & (retried > 0), F.lit("partial_retry_success"))
        .when(empty > 0, F.lit("gap_supplemented"))
        .otherwise(F.lit("full_mesh")),
    )


def failure_reason(has_geometry: Column, is_hidden: Column, fragments: Column) -> Column:
    return (
        F.when(~has_geometry, F.lit("NoGeometry"))
        .when(is_hidden, F.lit("Hidden"))
        .when(fragments == 0, F.lit("NoFragments"))
        .otherwise(F.lit("AllStrategiesFail"))
    )


def mesh_quality(
    is_container: Column, outcome: Column, reason: Column, box_usable: Column, supplemented: Column
) -> Column:
    """Mesh quality after the mesh, supplement and placeholder stages; NULL when none applies."""
    return (
        F.when(is_container, F.lit("skipped_container"))
        .when(supplemented, F.lit("fbx_supplemented"))
        .when(outcome.isNotNull(), outcome)
        .when(reason == "NoGeometry", F.lit("no_geometry"))
        .when(reason == "Hidden", F.lit("hidden"))
        .when(box_usable, F.lit("box_placeholder"))
    )


def mesh_status(
    com_failed: Column, is_hidden: Column, is_leaf: Column, fragments: Column, empty: Column,
    triangles: Column, lines: Column,
) -> Column:
    """Diagnostic status of one object's mesh."""
    return (
        F.when(com_failed, F.lit("COM_FAIL"))
        .when(is_hidden, F.lit("HIDDEN"))
        .when(~is_leaf & (fragments == 0), F.lit("PARENT_NO_FRAG"))
        .when(~is_leaf, F.lit("PARENT_HAS_FRAG"))
        .when(fragments == 0, F.lit("NO_FRAGMENTS"))
        .when((triangles == 0) & (lines > 0), F.lit("LINE_ONLY"))
        .when((triangles == 0) & (empty == fragments), F.lit("EMPTY_TESS"))
        .when(triangles == 0, F.lit("TESS_FAIL"))
        .when(triangles > 0, F.lit("OK"))
        .otherwise(F.lit("UNKNOWN"))
    )


def link_status(linked: Column, items: Column) -> Column:
    """Status line of a task: linked with its item count, or unlinked."""
    return F.when(linked, F.concat(F.lit("✓ 연결됨 ("), items.cast("string"), F.lit(" items)"))).otherwise(
        F.lit("✗ 미연결")
    )
